"""Broken prompt-response pairs: empty, truncated, refusing, copying answers, and answers in another language.

Evidence from the whole corpus comes first. The distinct responses are sorted by text; a response that a neighbour
begins with, where the neighbour's test code goes on, is a shortened version of it. The lengths of each model's responses are
counted; a length at which far more responses end than at those around it is a limit. An open answer (its fence isn't
closed) with such a mark is truncated, whatever its code looks like. Most cut answers have no longer version in the
table; of these the code tells (a quote, bracket or block left open, or an end before the first test). Rules for
copies, refusals and languages apply to the rest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..operators.batches import REMEMBERED, pieces

# ---------------------------------------------------------------------------------------------------------------- text

#: Characters nobody sees.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
#: Fillers that stand for nothing.
_FILLER = re.compile(
    r"(?i)^[\W_]*(?:n/?a|nil|null|none|undefined|nan|empty|todo|tbd|(?:no|empty) (?:output|response|answer|content|result|tests?)|not available|unknown|-+|\.+|…+|\{\s*\}|\[\s*\]|\"\"|'')?[\W_]*$"
)
#: Only an error of the transport. It is one line, so an answer that begins with such a word isn't one.
_TRANSPORT = re.compile(
    r"(?i)^[\[(]?\s*(?:error|exception|\[error|http(?: error)?|fatal|api ?error|requesterror|timeout ?error)\s*:?\]?\s*:?[^\n]{0,200}$"
)
_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[ \t]*([^\s`]*)[^\n]*$", re.M)

#: Names of the programming languages, as prompts and fences write them.
LANGUAGES = {
    "go": "go", "golang": "go", "php": "php", "rust": "rust", "rs": "rust", "ruby": "ruby", "rb": "ruby", "julia": "julia", "jl": "julia",
}
#: What only tests of a language have.
_TESTS = {
    "go": re.compile(r"\bfunc\s+(?:Test|Benchmark|Fuzz|Example)\w*\s*\(|\btesting\.[TBM]\b|\bt\.(?:Run|Errorf|Fatalf|Error|Fatal)\("),
    "php": re.compile(r"extends\s+\\?(?:PHPUnit\\Framework\\)?TestCase|function\s+test\w*\s*\(|->assert\w+\(|PHPUnit\\"),
    "rust": re.compile(r"#\[(?:\w+::)?test\]|#\[cfg\(test\)\]|\bassert(?:_eq|_ne)?!\s*\("),
    "ruby": re.compile(r"RSpec\.|^\s*(?:describe|context|it|specify)\s+['\":A-Z]|\bexpect[ (]|Minitest|def\s+test_|\.to\s+eq\b|spec_helper", re.M),
    "julia": re.compile(r"@testset|@test(?:_throws|_broken)?\b|\busing\s+Test\b"),
}
#: A test that has begun, without what a file of tests only starts with.
_BEGUN = {
    "go": re.compile(r"\bfunc\s+(?:Test|Benchmark|Fuzz|Example)\w*\s*\([^)]*\)\s*\{"),
    "php": re.compile(r"function\s+test\w*\s*\([^)]*\)[^{;]*\{|->assert\w+\("),
    "rust": re.compile(r"\bassert(?:_eq|_ne)?!\s*\(|\bfn\s+\w+\s*\([^)]*\)[^{;]*\{"),
    "ruby": re.compile(r"\bexpect[ (]|\bassert\w*\b|def\s+test_"),
    "julia": re.compile(r"@test(?:_throws|_broken)?\s+\S"),
}
#: How a file of code begins.
_CODE_START = re.compile(
    r"^\s*(?:package \w+\s*$|using [A-Z]\w*|#\[cfg\(|#!\[|<\?php|require(?:_relative)? ['\"]|import (?:\(|\"|[A-Z]\w+)|use \w+(?:::|\\)|module [A-Z]\w*|func \w|fn \w|pub fn \w|def \w|function \w|public function|final class|class [A-Z]|RSpec\.|describe ['\"]|@testset|mod tests)",
    re.M,
)
_CODE_PREFIXES = ("package ", "using Test", "#[cfg(test)]", "<?php", "require '")

#: Frequent words of human languages; words that several share are left out.
WORDS = {
    "en": "the of and to is are with below here this that test tests file cover following function case not code write for it on sure you find one per main branches create generate please answer only complete produce given from in a an",
    "es": "el la los las un una unos del al de que en y por se lo es con para sin según cuando después antes muy ningún cada más esta este nuestra nuestro pruebas prueba archivo siguientes cubren todas ramas escribe función responde aquí está genera cubra unitarias español informe muestra líneas lista vacía respuesta configuración",
    "pt": "o a os as um uma do da dos das no na nos nas ao de que em e por se é com para sem segundo quando depois antes muito nenhum cada mais esta este nossa nosso testes arquivo seguintes cobrem todos ramos aqui está não são relatório amostra já linhas lista vazia resposta",
    "de": "der die das den dem des ein eine einen einem und ist mit für auf im von zu ohne folgenden hier testdatei alle zweige decken ab schreibe erstelle bitte funktion antworte deutsch nicht wird wurde wenn nach bei jeder jede unser unsere noch",
    "fr": "le la les des un une du de que en et par se est avec pour sans selon quand après avant très aucun chaque plus cette ce notre nos tests fichier suivants couvrent toutes branches voici pas dans aux il lignes liste vide réponse",
    "it": "il lo gli i un una del di che in e per si è con senza secondo quando dopo prima molto ogni più questa questo nostro test file seguenti coprono tutti rami ecco non della sono",
}
_WORD_LANGS: dict[str, list[str]] = {}
for _lang, _list in WORDS.items():
    for _w in _list.split():
        _WORD_LANGS.setdefault(_w, []).append(_lang)
#: Letters that point to a language.
_LETTERS = {"ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "ß": "de", "ö": "de", "ü": "de", "ä": "de", "è": "fr", "ê": "fr", "œ": "fr", "û": "fr", "à": "fr"}
_CYRILLIC, _KANA, _HAN, _HANGUL = (re.compile(p) for p in ("[\u0400-\u04ff]", "[\u3040-\u30ff]", "[\u4e00-\u9fff]", "[\uac00-\ud7a3]"))

#: Declining a request, in several languages.
_REFUSAL = re.compile(
    r"(?i)\b(?:i|we)(?:['’]m| am|['’]re| are)?\s+(?:sorry|afraid|unable|not able|not comfortable|going to (?:have to )?(?:pass|decline))\b"
    r"|\b(?:i|we)\s+(?:can(?:no|['’])?t|cannot|won['’]?t|will not|don['’]t feel|do not feel|must|have to|need to|am not able to|refuse to|decline)\b"
    r"|\b(?:can(?:no|['’])t|cannot|unable to) (?:help|assist|comply|provide|fulfil|complete|write|generate|produce)\b"
    r"|\brequest declined\b|\bi apologi[sz]e\b|\bmy apologies\b|\bregrettably\b|\bunfortunately\b"
    r"|\bagainst my (?:usage )?(?:guidelines|policy|policies)\b|\bmy (?:policy|guidelines) (?:keeps?|prevents?|forbids?)\b|\boutside (?:of )?what i can do\b|\bnot something i can\b"
    r"|\bnot (?:be )?(?:appropriate|possible) for me\b|\bisn['’]t possible for me\b|\bas an ai\b|\bhave to pass\b|\bwon['’]t be (?:able|producing)\b"
    r"|\bes tut mir leid\b|\bkann ich (?:leider )?nicht\b|\bdarf ich (?:leider )?keine?\b|\bleider (?:kann|darf)\b|\bich kann (?:dabei |das |dir |ihnen )*(?:leider )?nicht\b"
    r"|\blo siento\b|\bno puedo\b|\bno me es posible\b|\bsinto muito\b|\bnão posso\b|\bnão me é possível\b|\bdésolée?\b|\bje ne peux pas\b|\bне могу\b|\bк сожалению\b|できません|申し訳"
)


def visible(text: str | None) -> str:
    return _INVISIBLE.sub("", text or "").strip()


def human_language(text: str) -> str | None:
    """Language of prose; None where too little points to one."""
    if len(_KANA.findall(text)) >= 3:
        return "ja"
    if len(_CYRILLIC.findall(text)) >= 8:
        return "ru"
    if len(_HANGUL.findall(text)) >= 4:
        return "ko"
    if len(_HAN.findall(text)) >= 4:
        return "zh"
    words = re.findall(r"[^\W\d_]+", re.sub(r"`[^`]*`|\b\w*[_\d]\w*\b|\b[a-z]+[A-Z]\w*\b", " ", text))
    score: dict[str, float] = {}
    for w in words:
        w = w.lower()
        langs = _WORD_LANGS.get(w, ())
        for lang in langs:
            score[lang] = score.get(lang, 0) + 1 / len(langs)
        for letter in w:
            if letter in _LETTERS:
                score[_LETTERS[letter]] = score.get(_LETTERS[letter], 0) + 0.5
    if not score:
        return None
    ranked = sorted(score.items(), key=lambda x: -x[1])
    best = ranked[0]
    second = ranked[1][1] if len(ranked) > 1 else 0
    return best[0] if best[1] >= 2 and best[1] > 1.3 * second else None


def blocks(text: str) -> tuple[list[tuple[str, str, bool]], str]:
    """Fenced blocks as (tag, code, closed), and the prose around them."""
    out, prose, at, opened = [], [], 0, None
    for m in _FENCE.finditer(text):
        if opened is None:
            prose.append(text[at : m.start()])
            opened = (m[2].lower(), m.end() + 1, m[1][0])
        elif m[1][0] == opened[2] and (not m[2] or opened[0]):
            out.append((opened[0], text[opened[1] : m.start()], True))
            opened, at = None, m.end()
            if m[2]:  # a fence that closes one block and opens the next
                opened = (m[2].lower(), m.end() + 1, m[1][0])
    if opened is not None:
        out.append((opened[0], text[opened[1] :], False))
    else:
        prose.append(text[at:])
    return out, "\n".join(prose)


def test_language(code: str) -> str | None:
    """Programming language whose tests the code holds."""
    counts = {lang: len(p.findall(code)) for lang, p in _TESTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


_C_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|/\*|\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'|[\"'`{}()\[\]]", re.S)
_RUST_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|/\*|\"(?:\\.|[^\"\\])*\"|'(?:\\[^']+|[^'\\])'|[\"{}()\[\]]", re.S)
_PHP_TOKEN = re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/|/\*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[\"'{}()\[\]]", re.S)
_RUBY_TOKEN = re.compile(r"(?<![\w&])#[^\n{]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[\"'{}()\[\]]|\bdo\b(?!\()|(?<![.\w:@$])end\b(?![?!:(])|^[ \t]*(?:def|class|module|if|unless|case|while|until|begin|for)\b(?![?!:=])", re.M | re.S)
_JULIA_TOKEN = re.compile(r"#=.*?=#|#[^\n]*|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|[\"{}()\[\]]|(?<![.\w:@!])(?:begin|function|if|for|while|let|try|struct|module|do(?!\()|quote|macro|end(?!\())\b(?![!?])", re.S)
_TOKENS = {"go": _C_TOKEN, "rust": _RUST_TOKEN, "php": _PHP_TOKEN, "ruby": _RUBY_TOKEN, "julia": _JULIA_TOKEN}
_CLOSE = {")": "(", "]": "[", "}": "{"}


def complete(code: str, language: str) -> bool:
    """Whether every quote, bracket and block of the code is closed and at least one test has begun."""
    code = code.rstrip()
    stack: list[str] = []
    for m in _TOKENS[language].finditer(code):
        t = m[0].strip()
        if not t:
            continue
        if t in ("(", "[", "{"):
            stack.append(t)
        elif t in _CLOSE:
            if stack and stack[-1] == _CLOSE[t]:
                stack.pop()
            else:
                return False
        elif t in ('"', "'", "`", "/*"):
            return False
        elif t[0] in "\"'`/#":
            continue
        elif language == "julia" and any(x in "([" for x in stack):
            continue
        elif t == "end":
            if stack and stack[-1] == "do":
                stack.pop()
            else:
                return False
        elif language == "ruby" and t == "do" and re.match(r"[ \t]*(?:while|until|for)\b", code[code.rfind("\n", 0, m.start()) + 1 : m.start()]):
            continue
        else:
            stack.append("do")
    return not stack and bool(_BEGUN[language].search(code))


def _squeezed(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text).strip().lower()


def copies(response: str, prompt: str) -> bool:
    """Whether the response only repeats the prompt, its instruction or its function (markup and a lead-in aside)."""
    r, p = _squeezed(response), _squeezed(prompt)
    if not r or not p:
        return False
    if r in p or p in r and len(r) < 1.2 * len(p) + 40:
        return len(r) >= 12
    r = re.sub(r"^(?:sure|question|prompt|user|instruction|task|q|certainly|okay|ok|of course)(?: question| task)? ", "", r)
    if r in p and len(r) >= 12:
        return True
    said = {_squeezed(s) for s in prompt.split("\n")}
    lines = [x for x in (_squeezed(s) for s in response.split("\n")) if len(x) > 3]
    if not lines:
        return False
    same = sum(len(x) for x in lines if x in said or len(x) > 8 and x in p)
    return same >= 0.9 * sum(map(len, lines))


def asked_language(prompt: str, language: str | None) -> str | None:
    """Programming language that the prompt asks for, else that of the record."""
    first = visible(prompt).split("\n")[0]
    if m := re.search(r"\b(Go|Golang|PHP|Rust|Ruby|Julia)\b", first):
        return LANGUAGES[m[1].lower()]
    for tag, _, _ in blocks(prompt)[0]:
        if tag in LANGUAGES:
            return LANGUAGES[tag]
    return LANGUAGES.get((language or "").strip().lower())


_FINISHED = re.compile(r"(?:[}\])\"'`.!?:;…]|\bend)$")


def verdicts(prompt: str | None, response: str | None, language: str | None) -> tuple[str | None, str | None, str | None]:
    """Defects of one pair: by itself, if a longer version continues its test code, and if it ends at a length limit."""
    text = visible(response)
    bare = re.sub(r"^[ \t]*(?:`{3,}|~{3,})[^\n`]*$", "", text, flags=re.M).strip() if "```" in text or "~~~" in text else text
    bare = re.sub(r"^`{3,}\w*\s*`{3,}$", "", bare)
    if not bare or len(bare) <= 60 and _FILLER.match(bare):
        return ("empty",) * 3
    if "\n" not in text and _TRANSPORT.match(text) and not _REFUSAL.search(text):
        return ("empty",) * 3
    prompt = visible(prompt)
    fenced, prose = blocks(text)
    if not fenced:
        m = _CODE_START.search(text)
        if m and (test_language(text[m.start() :]) or text.startswith(_CODE_PREFIXES)):
            prose, fenced = text[: m.start()], [("", text[m.start() :], False)]
    open_ = not fenced or not fenced[-1][2]
    tests = [(code, lang) for _, code, _ in fenced if (lang := test_language(code))]
    if not tests and prompt and copies(text, prompt):
        return ("copied",) * 3
    if not tests and _REFUSAL.search(prose if prose.strip() else text):
        return "refusal", "truncated" if fenced and open_ else "refusal", "refusal"
    asked = asked_language(prompt, language)
    if tests and asked and all(lang != asked for _, lang in tests):
        return ("wrong_language",) * 3
    own, theirs = human_language(prose), human_language(_instruction(prompt)) if prompt else None
    foreign = "wrong_language" if own is not None and theirs is not None and own != theirs else None
    if not tests:  # it breaks off before any test
        return foreign or "truncated", "truncated", "truncated"
    if any(not complete(code, lang) for code, lang in tests):
        return ("truncated",) * 3
    return foreign, "truncated" if open_ else foreign, "truncated" if open_ and not _FINISHED.search(text) else foreign


def defect(prompt: str | None, response: str | None, language: str | None, continued: bool = False, limited: bool = False) -> str | None:
    """Defect of one pair, or None. continued, limited: the marks of the corpus, see ``verdicts``."""
    plain, grown, ended = verdicts(prompt, response, language)
    return grown if continued and grown else ended if limited and ended else plain


def _instruction(prompt: str) -> str:
    """Prose of the prompt: its first line, and the rest outside code if that tells nothing."""
    first = prompt.split("\n")[0]
    return first if human_language(first) else blocks(prompt)[1]


# -------------------------------------------------------------------------------------------------------------- corpus

#: A shortened version has at least this many characters (fewer are the start of anything).
LEAST_PREFIX = 40
#: What a cut leaves at the end of a text.
TAIL = " \t\r\n.…"
#: Ranges of the sort for each shuffle partition, texts sampled for each range, and most characters of a range's bound.
RANGES, RANGE_SAMPLE, BOUND_CHARS = 4, 10, 20_000


def core(text: str | Column) -> Column:
    """The text without what a cut leaves at its end."""
    return F.rtrim(text, F.lit(TAIL))


def _goes_on(text: str, at: int) -> bool:
    """Whether the text has test code after ``at``, on the line cut there or before a fence closes."""
    end = text.find("\n```", at)
    end = len(text) if end < 0 else end
    start = at if text[at : at + 1] in ("\r", "\n") else text.rfind("\n", 0, at) + 1
    rest = text[start:end]
    return bool(text[at:end].strip()) and any(p.search(rest) for p in (*_TESTS.values(), *_BEGUN.values()))


def continuations(rows: Iterator[tuple[int, int, str]]) -> Iterator[int]:
    """Hashes of the texts that a later text begins with and goes on testing; rows (range, hash, text) in sorted order.

    In sorted order all longer versions of a text follow it at once, so the texts that the current one begins with are
    a stack: those that share no whole prefix with the next text are popped.
    """
    stack: list[list] = []  # length and hash of each text that the previous one begins with, and whether it is told
    before, before_range, before_hash = "", None, None
    for part, h, text in rows:
        if part != before_range:
            stack = []
        elif h == before_hash:
            continue
        while stack and not text.startswith(before[: stack[-1][0]]):
            stack.pop()
        for entry in stack:
            if not entry[2] and _goes_on(text, entry[0]):
                entry[2] = True
                yield entry[1]
        stack.append([len(text), h, False])
        before, before_range, before_hash = text, part, h


def shortened(df: DataFrame, text: str) -> DataFrame:
    """Hashes (``core_hash``) of the texts, without ``TAIL``, whose test code a longer text of the table continues.

    Each task first drops its repeated texts, so that a text that a third of all rows have is not moved with each row. The
    distinct texts are put into ranges whose bounds come from a sample of ``RANGE_SAMPLE`` texts a range (it sets where
    ranges begin, nothing else), then sorted by (range, text). A text that a bound begins with goes into the ranges after
    that bound, too, so every text meets all its longer versions, wherever they lie. Null texts and texts under
    ``LEAST_PREFIX`` characters are in no pair.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    texts = df.select(core(text).alias("__core")).where(F.length("__core") >= LEAST_PREFIX).select(F.xxhash64("__core").alias("core_hash"), "__core")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, texts.count() // (RANGES * n * RANGE_SAMPLE))
    sample = sorted({r[0] for r in texts.where(F.pmod("core_hash", F.lit(step)) == 0).select(F.substring("__core", 1, BOUND_CHARS)).distinct().toLocalIterator()})
    bounds = sample[RANGE_SAMPLE::RANGE_SAMPLE]
    arrow = pa.schema([("range", pa.int32()), ("core_hash", pa.int64()), ("__core", pa.string())])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ranges, keep = [], []
            for i, (h, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if h in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(h)
                at = bisect_right(bounds, t)
                ranges.append(at)
                keep.append(i)
                while at < len(bounds) and bounds[at].startswith(t):
                    at += 1
                    ranges.append(at)
                    keep.append(i)
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), rows.column(0), rows.column(1)], schema=arrow)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        found = continuations(rows)
        while out := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["core_hash"])

    routed = texts.mapInArrow(ranged, "range int, core_hash bigint, __core string")
    return routed.repartition(n, "range").sortWithinPartitions("range", "__core").mapInArrow(neighbours, "core_hash bigint").distinct()


def length_limits(df: DataFrame, text: str, group: str, least: int = 20, times: float = 6.0) -> DataFrame:
    """Lengths (``group, length``) at which ``times`` more texts end than at the 20 lengths around, and ``least`` at all.

    The histogram is pre-aggregated by group and length, so it has a row for each length, not for each text.
    """
    counts = df.where(F.length(text) > 0).groupBy(F.col(group).alias("group"), F.length(text).alias("length")).agg(F.count("*").alias("n"))
    around = Window.partitionBy("group").orderBy("length").rangeBetween(-10, 10)
    near = counts.withColumn("others", (F.sum("n").over(around) - F.col("n")) / 20.0)
    return near.where((F.col("n") >= least) & (F.col("n") >= times * F.greatest(F.col("others"), F.lit(1.0)))).select("group", "length")


def pair_defects(df: DataFrame, key: str, prompt: str, response: str, language: str, model: str) -> DataFrame:
    """Defective pairs: ``key, defect, evidence``; at most one row for each row of ``df``, in this order of precedence:
    ``empty``, ``copied`` or ``refusal`` (without test code), ``wrong_language`` or ``truncated``. ``evidence`` is
    ``longer_version`` or ``length_limit`` where a mark of the corpus decided, else ``text``.

    A null response is empty; a null prompt can't be copied or tell a language, then that of the record holds; rows that
    repeat a pair are each judged; texts are taken whole; other columns are ignored; an empty table gives an empty one.

    Shuffled are the distinct responses once (for the sort), a histogram of lengths, and small rows of numbers: texts are
    judged in one narrow pass, for each mark that may come, and the marks then pick. They come by joins on salted hashes, so
    that one response that a third of all rows have is spread over 16 tasks.
    """
    ship(df.sparkSession)
    salts = 16
    marks = df.select(F.col(response).alias("__response"), F.coalesce(F.col(model).cast("string"), F.lit("")).alias("__model"))
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    short = shortened(marks, "__response").select("core_hash", all_salts.alias("salt"), F.lit(True).alias("continued"))
    limits = length_limits(marks, "__response", "__model").select("group", "length", all_salts.alias("salt"), F.lit(True).alias("limited"))
    rows = df.select(
        F.col(key), F.col(prompt).alias("__prompt"), F.col(response).alias("__response"), F.col(language).cast("string").alias("__language"),
        F.coalesce(F.col(model).cast("string"), F.lit("")).alias("group"), F.length(response).alias("length"), F.xxhash64(core(response)).alias("core_hash"),
    )
    kept = [df.schema[key], T.StructField("group", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("core_hash", T.LongType())]
    found = ["plain", "grown", "ended"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                out = [verdicts(p, r, lang) for p, r, lang in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                some = pa.array([i for i, v in enumerate(out) if any(v)], pa.int64())
                columns = [part.column(i).take(some) for i in (0, 4, 5, 6)] + [pa.array([out[i][k] for i in some.to_pylist()], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "group", "length", "core_hash", *found])

    judged = rows.mapInArrow(judge, T.StructType(kept + [T.StructField(name, T.StringType()) for name in found]))
    judged = judged.withColumn("salt", F.pmod(F.hash(key), F.lit(salts)))
    judged = judged.join(short, ["core_hash", "salt"], "left").join(limits, ["group", "length", "salt"], "left")
    grown, ended = F.when(F.col("continued"), F.col("grown")), F.when(F.col("limited"), F.col("ended"))
    evidence = F.when(grown == "truncated", "longer_version").when((ended == "truncated") & (F.coalesce("plain", F.lit("")) != "truncated"), "length_limit").otherwise("text")
    return judged.select(key, F.coalesce(grown, ended, "plain").alias("defect"), evidence.alias("evidence")).where("defect IS NOT NULL")
