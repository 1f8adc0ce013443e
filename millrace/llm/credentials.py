"""Credentials embedded in source code: where they start, and the same code with only their values masked.

Lines are split and screened inside Arrow by one linear-time pattern, over whole files. On the lines that are left,
candidate values are cut out together with their context (the name they are assigned to, the key of an environment
lookup, a URL, a header, a command, a remark). All values of a batch are scored at once by their characters per subword
under a public vocabulary; the context then sets how natural a value may be: any credential context takes an unnatural
string, one that names a secret also words run together (``frosthammer13``), none takes a plain word. Only strings whose
shape or syntax leaves no doubt (``SHAPES``, private keys, passwords in URLs and basic headers) need no score. Redaction
replaces value characters one for one, so that every offset, quote and line of the surrounding code stays.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from ..operators.batches import REMEMBERED, pieces
from .tokens import TOKENIZER_DIR, TOKENIZER_FILE, chars_per_token

#: Strings with fewer characters per subword than this are unnatural; longer ones are made of words.
UNNATURAL = 2.4
#: Where the context names a secret, strings with fewer characters per subword than this are taken; plain words have more.
WORD_LIKE = 5.0

#: Words of a name that say its value is secret.
SECRET_WORDS = (
    "password passwd passwort pwd pw pass passphrase secret secrets token credential credentials cred creds auth authorization "
    "bearer apikey apitoken authtoken accesstoken secretkey privatekey jwt"
).split()
#: With ``key`` they say the same.
KEY_WORDS = "api access signing private secret encryption license client master ssh auth account service shared hmac deploy storage".split()
#: Last words of names that are about a secret but don't hold one.
ABOUT_WORDS = (
    "label pattern name budget count limit type length len url uri path file field header id ids size max min regex format prefix "
    "suffix hint title text message placeholder env var index cache ttl timeout expiry expires policy help prompt"
).split()
#: Strings with a shape that only credentials have.
SHAPES = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9_]{22,}"
    r"|glpat-[A-Za-z0-9_-]{18,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{12,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|[a-z]{2,6}_(?:pat|key|tok|sec)_[A-Za-z0-9]{20,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|npm_[A-Za-z0-9]{36}"
    r"|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
#: Beginnings of such strings, as they stand before a cut.
PREFIXES = r"(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abeprs]-|[sr]k_(?:live|test)_|[a-z]{2,6}_(?:pat|key|tok|sec)_|AIza|npm_|hf_|eyJ)"

_SHAPE = re.compile(rf"(?<![A-Za-z0-9_])(?:{SHAPES})")
_CUT_SHAPE = re.compile(rf"""(?P<quote>['"`])(?P<value>{PREFIXES}[\w.-]*)(?P=quote)""")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@'\"<>]*:([^\s'\"]+)@[A-Za-z0-9\[]")
_HEADER = re.compile(r"(?i)(?:^|['\"\s:])(basic|bearer|token|apikey)\s+([^\s'\"`,;)]{6,})")
_COMMANDS = re.compile(
    r"redis-cli\b[^'\"`|]*?\s-a\s+(?P<a>[^\s'\"`]+)"
    r"|sshpass\s+-p\s*(?P<b>[^\s'\"`]+)"
    r"|(?:mysql|mysqldump|mariadb|mysqladmin)\b[^'\"`|]*?\s-p(?P<c>[^\s'\"`]+)"
    r"|(?:curl|wget|http)\b[^'\"`|]*?\s(?:-u|--user)[\s=]+[^\s:'\"`]+:(?P<d>[^\s'\"`]+)"
    r"|--?(?:password|passwd|pass|token|secret|api-key)[\s=]+(?P<e>[^\s'\"`]+)"
    r"|\bPGPASSWORD=(?P<f>[^\s'\"`]+)"
)
_COMMENT = re.compile(r"^\s*(?://+|#+|/\*+|\*+|--|;+|<!--|%)\s*(.*?)\s*(?:\*/|-->)?\s*$")
_REMARK_WORDS = r"\b(?:pass(?:word|wd|phrase|code)?|pwd?|token|secret|credentials?|creds?|api.?key|key|log.?in|sign.?in|works with)\b"
_REMARK = re.compile(f"(?i){_REMARK_WORDS}")
_REMARK_VALUE = re.compile(r"(?i)(?:\bis|\bwas|[:=]|->|=>|\btype|\bwith|\buse|\benter|/)\s+[`'\"]?([^\s'\"`]{6,})[`'\"]?[.;,]?$|(?:\bwith|\bas|\buse)\s+[\w.-]+/([^\s'\"`]{6,})$|\bpw[:=]([^\s'\"`]{6,})$")
#: name, an operator or a comma between key and value, then a quoted value
_NAMED = re.compile(
    r"""(?<![\w$@.-])(?=(?P<open>['"]?)(?P<name>[A-Za-z_$@][\w$.-]*)['"]?\s*\]?\s*(?P<op>:\s*(?:&\s*(?:'static\s+)?)?[A-Za-z][\w<>:\s]*=|:=|=>|:|=|,)\s*(?:[A-Za-z_][\w:.]*!?\(\s*|\(\s*|\[\s*)?[rbfu@]{0,2}#?(?P<quote>['"`])(?P<value>(?:\\.|(?!(?P=quote)).)*)(?P=quote))"""
)
_NAMED_OPEN = re.compile(
    r"""(?P<name>[A-Za-z_$@][\w$.-]*)['"]?\s*\]?\s*(?::\s*(?:&\s*(?:'static\s+)?)?[A-Za-z][\w<>:\s]*=|:=|=>|:|=)\s*(?:[A-Za-z_][\w:.]*!?\(\s*|\(\s*|\\\s*)?$"""
)
_FALLBACK = re.compile(
    r"""(?=(?P<k>['"])(?P<name>[A-Za-z][A-Za-z0-9_]{2,})(?P=k)\s*\]?\s*(?:,|\)\s*\.(?:unwrap_or|unwrap_or_else|or|fetch|getOrElse)\s*\((?:\|\w*\|\s*)?|\)\s*(?:\?:|\?\?|\|\||or)|(?:\?\?|\|\||or|\?:))\s*(?P<quote>['"])(?P<value>(?:\\.|(?!(?P=quote)).)*)(?P=quote))"""
)
_BARE = re.compile(r"""^\s*(?:export\s+|set\s+|-\s+)?(?P<name>[A-Za-z_][\w.-]*)\s*(?:=|:)\s*(?P<value>[^\s'"`(){}\[\],;]+)\s*$""")
_CONTINUED = re.compile(r"""^\s*(?:[.+*,&\\|]|\.\.|<<)?\s*(?P<quote>['"`])(?P<value>[^'"`\s]+)(?P=quote)""")
_MORE = re.compile(r"""\s*(?:[.+*,&\\|]|\.\.|<<)\s*(?P<quote>['"`])(?P<value>[^'"`\s]+)(?P=quote)""")
_OPEN_END = re.compile(r"""^\s*(?:[.+*,&\\|]|\.\.|<<)\s*\\?\s*$""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(
    r"(?i)^[<\[{(%$*#.].*[>\]})%]$|\$\{|\{\{|\$\(|#\{|<[^>]*>|%[sdv@]|^\$[A-Za-z_]\w*$|^%[A-Za-z_]\w*%$|^[*x.#_•-]+$|^(.)\1{5,}$"
    r"|(?:^|[-_. ])(?:your|my|some)[-_. ]|(?:^|[-_. ])(?:insert|enter|replace|change|todo|tbd|fixme|example|sample|dummy|placeholder|redacted|removed|unset|none|null|nil|undefined)(?:$|[-_. ])"
    r"|changeme|replace_?me|xxxx|\.\.\.|^(?:true|false|null|none|nil|unset|default|disabled|enabled|password|secret|token|apikey|api_key)$|EXAMPLE$"
)
#: Places that a template fills.
_FILLED = re.compile(r"\$\{[^}]*\}|\{\{.*?\}\}|\$\([^)]*\)|#\{[^}]*\}|<[^>]*>|%[sdv@]")
_CALL = re.compile(r"^[A-Za-z_$][\w$.>:-]*\(.*\)$|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
_MEMBER = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)+(?:\(.*\)?)?;?$")

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_LOWER, _TITLE, _UPPER = ("|".join(map(f, SECRET_WORDS)) for f in (str.lower, str.title, str.upper))
#: Screens lines inside Arrow, made of what each rule needs in a line; a line without any of this has no credential.
SCREEN = "|".join(
    (
        rf"(?:^|[^A-Za-z])(?:{_LOWER})(?:[^a-z]|$)|(?:{_TITLE})(?:[^a-z]|$)|(?:^|[^A-Z])(?:{_UPPER})",  # words of names
        rf"(?i:(?:{'|'.join(KEY_WORDS)})[^a-z0-9]*key)",
        rf"{PREFIXES}|\bSG\.|-----BEGIN",
        r"://[^\s/:@'\"<>]*:[^\s'\"]+@[A-Za-z0-9\[]",
        r"(?i:(?:basic|bearer|token|apikey)[^a-z])",
        rf"redis-cli|sshpass|(?:mysql|mariadb).*{_SPACE}-p|(?:curl|wget|http).*{_SPACE}(?:-u|--user)|-(?:password|passwd|pass|token|secret|api-key)|PGPASSWORD=",
        rf"^{_SPACE}*(?://|#|/\*|\*|--|;|<!--|%).*(?i:{_REMARK_WORDS})",
    )
)


def secret_name(name: str) -> bool:
    """Whether a name says that its value is a secret (and not something about one)."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT_WORDS or "max" in words or "min" in words or "public" in words:
        return False
    for i, w in enumerate(words):
        if w in SECRET_WORDS or (w == "key" and i and words[i - 1] in KEY_WORDS):
            return True
    return False


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value)) or len(set(value)) < 4


def template(value: str) -> bool:
    """Whether the value has a place to fill in."""
    return bool(_FILLED.search(value))


def _kinds(value: str) -> tuple[bool, bool, bool, bool]:
    return tuple(bool(re.search(p, value)) for p in (r"\d", r"[a-z]", r"[A-Z]", r"[^A-Za-z0-9_]"))


def plausible(value: str, cpt: float, quoted: bool, strong: bool, rest: tuple[str, float] | None = None) -> bool:
    """Whether a value can be a live secret. cpt: characters per subword; strong: the context names a secret.

    rest: of a value that looks like a template, what lies outside the places to fill in, and its characters per
    subword. A random password may well hold ``%s``: its rest is as unnatural as the whole.
    """
    if rest is not None and not placeholder(rest[0]) and len(rest[0]) >= 8 and rest[1] < UNNATURAL and sum(_kinds(rest[0])[:3]) >= 3:
        return strong and not re.search(r"\s", value)
    if len(value) < 6 or placeholder(value) or re.search(r"\s", value):
        return False
    if _CALL.match(value) or not quoted and _MEMBER.match(value) and not re.search(r"\d\d;?$", value):
        return False
    digit, lower, upper, special = _kinds(value)
    kinds = digit + (lower or upper) + special
    if len(value) >= 8 and (cpt < UNNATURAL and (kinds >= 2 or len(value) >= 16) or cpt < 2.0 and lower and upper):
        return True
    return strong and cpt < WORD_LIKE and kinds >= 2 and (digit or special and cpt < 3.2 and len(value) >= 8)


@dataclass(frozen=True)
class Candidate:
    """A value in its context: line (index in the file), columns in the line, and the pieces that follow on later lines."""

    line: int
    start: int
    end: int
    value: str
    rule: str
    strong: bool
    quoted: bool
    sure: bool = False
    more: tuple[tuple[int, int, int], ...] = ()


def candidates(lines: list[str], at: int) -> list[Candidate]:
    """Candidate values of one screened line; ``lines`` is the whole file."""
    line = lines[at]
    out: list[Candidate] = []
    if m := _PEM.search(line):
        return [_pem(lines, at, m)]
    for m in _SHAPE.finditer(line):
        out.append(Candidate(at, m.start(), m.end(), m[0], "shape", True, True, sure=True))
    for m in _URL.finditer(line):
        value = m[1]
        out.append(Candidate(at, m.start(1), m.end(1), value, "url", True, False, sure=len(value) >= 5))
    for m in _HEADER.finditer(line):
        kind, value = m[1].lower(), m[2]
        if kind == "basic":
            try:
                user, colon, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
            except (binascii.Error, UnicodeDecodeError, ValueError):
                continue
            if colon and word and not placeholder(word):
                out.append(Candidate(at, m.start(2), m.end(2), value, "header", True, True, sure=True))
        else:
            out.append(Candidate(at, m.start(2), m.end(2), value, "header", False, True))
    for m in _COMMANDS.finditer(line):
        k = m.lastgroup
        value = m[k].split("@")[0] if k == "d" and re.search(r"@[\w.-]+\.\w+", m[k]) else m[k]
        out.append(Candidate(at, m.start(k), m.start(k) + len(value), value, "command", True, False))
    for m in _FALLBACK.finditer(line):
        if secret_name(m["name"]):
            out.append(Candidate(at, m.start("value"), m.end("value"), m["value"], "fallback", True, True))
    for m in _NAMED.finditer(line):
        if (m["op"] != "," or m["open"]) and secret_name(m["name"]):
            more, value = _pieces(lines, at, m.end("value") + 1, m["value"])
            out.append(Candidate(at, m.start("value"), m.end("value"), value, "named", True, True, bool(_SHAPE.fullmatch(value)), more))
    for m in _CUT_SHAPE.finditer(line):
        more, value = _pieces(lines, at, m.end("value") + 1, m["value"])
        if more and _SHAPE.fullmatch(value):
            out.append(Candidate(at, m.start("value"), m.end("value"), value, "shape", True, True, True, more))
    if m := _NAMED_OPEN.search(line):
        if secret_name(m["name"]) and at + 1 < len(lines) and (c := _CONTINUED.match(lines[at + 1])):
            more, value = _pieces(lines, at + 1, c.end("value") + 1, c["value"])
            out.append(Candidate(at + 1, c.start("value"), c.end("value"), value, "named", True, True, more=more))
    if m := _BARE.match(line):
        if secret_name(m["name"]):
            out.append(Candidate(at, m.start("value"), m.end("value"), m["value"], "bare", True, False))
    if (m := _COMMENT.match(line)) and _REMARK.search(m[1]):
        if v := _REMARK_VALUE.search(m[1]):
            k = v.lastindex
            value = re.sub(r"@[\w-]+(?:\.[\w-]+)+(?::\d+)?$", "", v[k])
            start = m.start(1) + v.start(k)
            out.append(Candidate(at, start, start + len(value), value, "remark", True, False))
    return out


def _pieces(lines: list[str], at: int, column: int, value: str) -> tuple[tuple[tuple[int, int, int], ...], str]:
    """Further pieces of a value that is put together from several literals, also over line ends."""
    more: list[tuple[int, int, int]] = []
    while True:
        if m := _MORE.match(lines[at], column):
            more.append((at, m.start("value"), m.end("value")))
            value += m["value"]
            column = m.end("value") + 1
        elif _OPEN_END.match(lines[at][column:]) and at + 1 < len(lines) and (m := _CONTINUED.match(lines[at + 1])):
            at += 1
            more.append((at, m.start("value"), m.end("value")))
            value += m["value"]
            column = m.end("value") + 1
        else:
            return tuple(more), value


def _pem(lines: list[str], at: int, m: re.Match) -> Candidate:
    """A private key from its first line to its last; what is masked is the text between the two."""
    more: list[tuple[int, int, int]] = []
    rest = lines[at][m.end() :]
    if e := _PEM_END.search(rest):
        body = rest[: e.start()]
        return Candidate(at, m.end(), m.end() + e.start(), body, "key", True, True, sure=len(re.sub(r"\W|\\n", "", body)) >= 24)
    k = at + 1
    while k < len(lines) and not _PEM_END.search(lines[k]) and not _PEM.search(lines[k]):
        s = lines[k].rstrip("\r")
        left = len(s) - len(s.lstrip())
        if s.strip():
            more.append((k, left, len(s.rstrip())))
        k += 1
    body = "".join(lines[i][a:b] for i, a, b in more)
    return Candidate(at, m.end(), m.end(), body, "key", True, True, sure=k < len(lines) and len(body) >= 24, more=tuple(more))


def find(texts: list[str], folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE) -> list[list[Candidate]]:
    """Credentials of each text, in order. Characters per subword are taken for all candidates of the batch at once."""
    if not texts:
        return []
    split = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    lines, offsets = split.values, split.offsets.to_numpy()
    hits = np.flatnonzero(pc.match_substring_regex(lines, SCREEN).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(offsets, hits, side="right") - 1
    found: list[list[Candidate]] = [[] for _ in texts]
    asked: list[tuple[int, Candidate]] = []
    whole: dict[int, list[str]] = {}
    for i, k in zip(hits.tolist(), owner.tolist(), strict=True):
        if k not in whole:
            whole.clear()
            whole[k] = texts[k].split("\n")
        for c in candidates(whole[k], i - int(offsets[k])):
            asked.append((k, c))
    rests = {c.value: _FILLED.sub("", c.value) for _, c in asked if template(c.value)}
    values = list({c.value for _, c in asked} | set(rests.values()))
    cpt = dict(zip(values, chars_per_token(values, folder, vocabulary), strict=True))
    for k, c in asked:
        rest = (rests[c.value], cpt[rests[c.value]]) if c.value in rests else None
        if c.sure and not placeholder(c.value) or not c.sure and plausible(c.value, cpt[c.value], c.quoted, c.strong, rest):
            found[k].append(c)
    return [_distinct(x) for x in found]


def _distinct(found: list[Candidate]) -> list[Candidate]:
    """Without those that overlap an earlier one, or begin in a piece of one that goes over several lines."""
    out: list[Candidate] = []
    line, end = -1, 0
    pieces_of: dict[int, list[tuple[int, int]]] = {}
    for c in sorted(found, key=lambda c: (c.line, c.start, -c.end)):
        if c.line != line:
            line, end = c.line, 0
        if c.start < end or any(b <= c.start < e for b, e in pieces_of.get(line, ())):
            continue
        out.append(c)
        end = max(end, c.end)
        for at, b, e in c.more:
            if at == line and b <= end:
                end = max(end, e)
            else:
                pieces_of.setdefault(at, []).append((b, e))
    return out


def redact(text: str, found: list[Candidate], mask: str = "*") -> str:
    """The text with every character of the values replaced by ``mask``; its length and lines stay."""
    if not found:
        return text
    lines = text.split("\n")
    for c in found:
        for at, start, end in ((c.line, c.start, c.end), *c.more):
            s = lines[at]
            lines[at] = s[:start] + mask * (end - start) + s[end:]
    return "\n".join(lines)


def credentials(df: DataFrame, path: str, content: str, redacted: bool = False, folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE) -> DataFrame:
    """One row for each credential (or, with ``redacted``, each file that has one) of distinct files.

    path: the file's key, of any type. Columns: ``path``, then ``line_no, column_start, column_end, rule`` (1-based line, 0-based columns in code points), or
    ``n_credentials`` and the redacted ``content``. Rows with null content give nothing; empty and very long texts are
    taken whole; rows that repeat a file are read once in each task, and the few rows left of each task are made distinct
    by a shuffle of positions, not of texts. Other columns are ignored.
    """
    ship(df.sparkSession)
    path_type = df.schema[path].dataType
    fields = [T.StructField(path, path_type)]
    if redacted:
        fields += [T.StructField("n_credentials", T.IntegerType()), T.StructField(content, T.StringType())]
        arrow = pa.schema([(path, to_arrow_type(path_type)), ("n_credentials", pa.int32()), (content, pa.string())])
    else:
        fields += [T.StructField(n, T.IntegerType()) for n in ("line_no", "column_start", "column_end")] + [T.StructField("rule", T.StringType())]
        arrow = pa.schema([(path, to_arrow_type(path_type)), ("line_no", pa.int32()), ("column_start", pa.int32()), ("column_end", pa.int32()), ("rule", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in pieces(batch, 2):
                names, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
                fresh = []
                for i, key in enumerate(zip(names, hashes, strict=True)):
                    if key not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(key)
                        fresh.append(i)
                if not fresh:
                    continue
                texts = part.column(2).take(pa.array(fresh)).to_pylist()
                rows: list[tuple] = []
                for i, text, found in zip(fresh, texts, find(texts, folder, vocabulary), strict=True):
                    if redacted and found:
                        rows.append((names[i], len(found), redact(text, found)))
                    elif found:
                        rows += [(names[i], c.line + 1, c.start, c.end, c.rule) for c in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    files = df.where(F.col(content).isNotNull()).select(F.col(path), F.xxhash64(content).alias("__hash"), F.col(content))
    return files.mapInArrow(run, T.StructType(fields)).distinct()
