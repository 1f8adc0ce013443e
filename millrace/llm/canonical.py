"""One consistent form for texts that are displayed alike.

The text of an Arrow batch is taken as one array of code points. Every code point is replaced through a lookup table
(full decompositions, ligatures, full-width forms, kinds of spaces and hyphens, look-alike letters; characters nobody
sees are dropped), with expansion offsets for replacements of another length. Combining marks are then put in canonical
order and composed pairwise, all of it with array operations over the batch; no Python string is touched row by row.

Look-alike letters are folded in two ways. The skeleton, which tells whether two texts are displayed alike, takes the Latin
letter everywhere. The canonical form, which is published, takes the letter of the script that the rest of the word is in, so
that words of other scripts stay what they are: a letter that any script might have written follows those that only one has.

Kept apart, as they are displayed differently: case, accents, raised, lowered and circled characters, and emoji,
including the joiners and variation selectors that hold an emoji sequence together.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship
from ..operators.batches import pieces

#: Letters of other scripts that are drawn like Latin ones, as "look-alikes" -> "Latin letters", position by position.
LOOKALIKES = [
    # Cyrillic
    ("асеԁһіјӏорԛѕухүԝѵ", "acedhijlopqsyxywv"),
    ("АВСЕԌНІЈКМОРԚЅТУҮХԜ", "ABCEGHIJKMOPQSTYYXW"),
    # Greek
    ("αικνορυχϲϳ", "aikvopuxcj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    # Armenian
    ("օոսհցզ", "onuhgq"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRRSTVWYZ"),
    # Lisu
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    # Latin letters of other alphabets; small capitals follow by their names
    ("ɑɡıɩʏ", "agiiy"),
]
#: Latin letters that a word of the other script takes its own letter for, position by position.
OTHER_SCRIPTS = {
    "CYRILLIC": ("aceopxyiABCEHIKMOPTXY", "асеорхуіАВСЕНІКМОРТХУ"),
    "GREEK": ("aikovpuxABEZHIKMNOPTYX", "αικονρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"),
}
#: Drawn as a hyphen.
HYPHENS = "‐‑‒⁃−˗﹣－"
#: Code points without any picture of their own (first, last).
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Parts of emoji sequences; they are kept after an emoji.
JOINERS = [(0x200D, 0x200D), (0xFE0E, 0xFE0F), (0xE0020, 0xE007F)]
#: Blocks of emoji and pictographs.
EMOJI = [(0x2190, 0x21FF), (0x2300, 0x23FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3299)]
#: Tags of decompositions whose result is displayed otherwise than the character.
APART = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")

#: Bytes of text whose code points are held at once, in some arrays of eight bytes each.
PIECE_BYTES = 1 << 20

_TOP = sys.maxunicode + 1
_DROP, _HANGUL = -1, range(0xAC00, 0xD7A4)


def latin_letters() -> dict[int, int]:
    """Latin letter by look-alike: ``LOOKALIKES`` and the small capitals."""
    out = {ord(a): ord(b) for others, ours in LOOKALIKES for a, b in zip(others, ours, strict=True)}
    small = {0x1D00 + i: unicodedata.name(chr(0x1D00 + i), "").removeprefix("LATIN LETTER SMALL CAPITAL ") for i in range(0x24)}
    return {cp: ord(name.lower()) for cp, name in small.items() if len(name) == 1} | out


class Tables:
    """Lookup tables over all code points, built once in each Python worker. skeleton: look-alikes become Latin letters."""

    def __init__(self, skeleton: bool) -> None:
        latin = latin_letters() if skeleton else {ord(c): ord(c) for c in "ϲϹ"}  # their decomposition is drawn otherwise
        latin |= {ord(c): ord("-") for c in HYPHENS}
        memo: dict[int, list[int]] = {}

        def full(cp: int) -> list[int]:
            if cp in memo:
                return memo[cp]
            memo[cp] = [cp]
            if cp in latin:
                out = [latin[cp]]
            elif unicodedata.category(chr(cp)) == "Zs":
                out = [0x20]
            elif cp in _HANGUL:
                out = [ord(c) for c in unicodedata.normalize("NFD", chr(cp))]
            else:
                parts = unicodedata.decomposition(chr(cp)).split()
                tag = parts.pop(0) if parts and parts[0][0] == "<" else ""
                if not parts or tag in APART:
                    out = [cp]
                else:
                    out = [y for x in parts for y in full(int(x, 16))]
                    if tag and out[0] == 0x20 and len(out) > 1:  # a spacing accent stays what it is
                        out = [cp]
            memo[cp] = out
            return out

        count = np.ones(_TOP, np.int32)
        first = np.arange(_TOP, dtype=np.int32)
        more: list[tuple[int, list[int]]] = []
        ccc = np.zeros(_TOP, np.uint8)
        pairs: dict[int, int] = {}
        for cp in range(_TOP):
            if 0xD800 <= cp < 0xE000 or 0x20000 <= cp < 0x2F800 or cp >= 0x30000:
                continue
            c = chr(cp)
            if k := unicodedata.combining(c):
                ccc[cp] = k
            decomposition = unicodedata.decomposition(c)
            if cp in latin or cp in _HANGUL or decomposition or unicodedata.category(c) == "Zs":
                out = full(cp)
                if out != [cp]:
                    count[cp] = len(out)
                    first[cp] = out[0]
                    if len(out) > 1:
                        more.append((cp, out))
            if decomposition and decomposition[0] != "<" and " " in decomposition and unicodedata.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in decomposition.split())
                a, b = full(a), full(b)
                # the first part in the form it has after the passes before
                if len(b) == 1:
                    head = a[0] if len(a) == 1 else ord(unicodedata.normalize("NFC", "".join(map(chr, a)))[0])
                    pairs.setdefault(head << 21 | b[0], full_composed(cp, full))
            if cp in _HANGUL:
                lead, vowel, *tail = out
                if tail:
                    pairs[(cp - (tail[0] - 0x11A7)) << 21 | tail[0]] = cp
                else:
                    pairs[lead << 21 | vowel] = cp
        for low, high in INVISIBLE:
            count[low : high + 1] = 0
        self.count, self.first, self.ccc = count, first, ccc
        self.start = np.zeros(_TOP, np.int32)
        flat: list[int] = []
        for cp, out in more:
            self.start[cp] = len(flat)
            flat += out
        self.flat = np.asarray(flat or [0], np.int32)
        self.emoji = np.zeros(_TOP, bool)
        for low, high in EMOJI:
            self.emoji[low : high + 1] = True
        self.joiner = np.zeros(_TOP, bool)
        for low, high in JOINERS:
            self.joiner[low : high + 1] = True
        keys = np.asarray(sorted(pairs), np.int64)
        self.pair_keys, self.pair_values = keys, np.asarray([pairs[k] for k in keys.tolist()], np.int32)
        seconds = np.zeros(_TOP, bool)
        seconds[keys & 0x1FFFFF] = True
        self.second = seconds


def full_composed(cp: int, full) -> int:
    """The one code point that stands for all characters with the decomposition of ``cp``: a Latin one if there is one."""
    parts = full(cp)
    composed = unicodedata.normalize("NFC", "".join(map(chr, parts)))
    return ord(composed) if len(composed) == 1 else cp


@cache
def tables(skeleton: bool) -> Tables:
    return Tables(skeleton)


LATIN, CYRILLIC, GREEK, OTHER = range(1, 5)


class Scripts:
    """By code point: the script of a letter, the Latin letter it looks like, and the Cyrillic and Greek one (0: none)."""

    def __init__(self) -> None:
        numbers = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK}
        self.script = np.zeros(_TOP, np.uint8)
        self.mark = np.zeros(_TOP, bool)
        self.latin = np.zeros(_TOP, np.int32)
        self.own = {n: np.zeros(_TOP, np.int32) for n in (CYRILLIC, GREEK)}
        latin = latin_letters()
        turned = {numbers[name]: {ord(a): ord(b) for a, b in zip(*pairs, strict=True)} for name, pairs in OTHER_SCRIPTS.items()}
        for cp in range(0x20000):  # letters above are ideographs
            c = chr(cp)
            kind = unicodedata.category(c)
            self.mark[cp] = kind[0] == "M"
            if kind[0] != "L":
                continue
            self.script[cp] = numbers.get(unicodedata.name(c, "").split(" ")[0], OTHER)
            base, *marks = unicodedata.normalize("NFD", c)  # a letter with accents follows its base
            for table, letters in ((self.latin, latin), *((self.own[n], m) for n, m in turned.items())):
                if ord(base) in letters:
                    whole = unicodedata.normalize("NFC", chr(letters[ord(base)]) + "".join(marks))
                    if len(whole) == 1:
                        table[cp] = ord(whole)
        self.open = (self.latin > 0) | (self.script == LATIN) & ((self.own[CYRILLIC] > 0) | (self.own[GREEK] > 0))


@cache
def scripts() -> Scripts:
    return Scripts()


def folded_codes(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Code points with the look-alikes of each word in one script.

    It is the script of most letters in the word that no other script draws. A word without such letters is Latin if it
    is of several scripts or the whole text is Latin (counted in the same way), else it stays: a text in
    another script keeps its own short words.
    """
    s = scripts()
    script = s.script[codes]
    if not (s.latin[codes] > 0).any() and not (script > LATIN).any():
        return codes
    inside = (script > 0) | s.mark[codes]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(new)
    words = int(word[-1]) + 1
    letter = script > 0
    open_ = s.open[codes]
    sure = letter & ~open_
    width = OTHER + 1
    per_word = np.bincount(word[sure] * width + script[sure], minlength=words * width).reshape(words, width)
    per_row = np.bincount(row[sure].astype(np.int64) * width + script[sure], minlength=(int(row[-1]) + 1) * width).reshape(-1, width)
    held = np.bincount(word[letter] * width + script[letter], minlength=words * width).reshape(words, width)
    row_of = np.zeros(words, np.int64)
    row_of[word[letter]] = row[letter]
    target = np.where(per_word.any(1), per_word.argmax(1), 0)
    text = np.where(per_row.any(1), per_row.argmax(1), LATIN)[row_of]
    mixed = (held > 0).sum(1) > 1
    target = np.where((target == 0) & (mixed | (text == LATIN)), text, target)[word]
    out = codes.copy()
    turn = letter & open_ & (target > 0) & (target < OTHER)
    latin = np.where(s.latin[codes] > 0, s.latin[codes], codes)
    for n, table in s.own.items():
        at = turn & (target == n) & (script != n)
        out[at] = np.where(table[latin[at]] > 0, table[latin[at]], codes[at])
    at = turn & (target == LATIN)
    out[at] = latin[at]
    return out


def canonical_codes(codes: np.ndarray, row: np.ndarray, skeleton: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points (or those of the skeleton), and the row of each; ``codes`` and ``row`` are those of the stored texts."""
    t = tables(skeleton)
    if not len(codes):
        return codes, row
    # 1. what nobody sees is dropped, but for what holds an emoji sequence together
    n = t.count[codes].copy()
    joiner = t.joiner[codes]
    if joiner.any():
        at = np.flatnonzero(joiner)
        # the last code point before it that is no joiner must be an emoji of the same row
        solid = np.where(joiner, -1, np.arange(len(codes)))
        np.maximum.accumulate(solid, out=solid)
        before = solid[at]
        keep = (before >= 0) & t.emoji[codes[np.maximum(before, 0)]] & (row[np.maximum(before, 0)] == row[at])
        after = np.minimum(at + 1, len(codes) - 1)
        zwj = codes[at] == 0x200D
        follows = (t.emoji[codes[after]] | t.joiner[codes[after]]) & (row[after] == row[at]) & (after > at)
        keep &= ~zwj | follows
        n[at] = keep
    # 2. gather replacements by expansion offsets
    total = int(n.sum())
    origin = np.repeat(np.arange(len(codes)), n)
    within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    source = codes[origin]
    longer = t.count[source] > 1
    out = t.first[source].astype(np.int64)
    if longer.any():
        out[longer] = t.flat[t.start[source[longer]] + within[longer]]
    rows = row[origin]
    # 3. canonical order of the marks between two starters
    ccc = t.ccc[out]
    if ccc.any():
        new_row = np.empty(total, bool)
        new_row[0] = True
        new_row[1:] = rows[1:] != rows[:-1]
        segment = np.cumsum((ccc == 0) | new_row)
        unsorted = (ccc[1:] < ccc[:-1]) & (ccc[1:] > 0) & (segment[1:] == segment[:-1])
        if unsorted.any():
            order = np.argsort(segment.astype(np.int64) << 8 | ccc, kind="stable")
            out = out[order]
    # 4. compose, and once more where folded letters take the marks behind them
    out, rows = composed_codes(out, rows, t)
    if not skeleton and len(out):
        out, rows = composed_codes(folded_codes(out, rows), rows, t)
    return out, rows


def composed_codes(out: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Code points composed pairwise within each row, until nothing composes any more."""
    while len(out) > 1 and len(t.pair_keys):
        ok = t.second[out[1:]] & (rows[1:] == rows[:-1])
        at = np.flatnonzero(ok)
        if not len(at):
            break
        key = out[at].astype(np.int64) << 21 | out[at + 1]
        where = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = t.pair_keys[where] == key
        at, where = at[hit], where[hit]
        if len(at) > 1:  # of overlapping pairs the first composes now
            free = np.ones(len(at), bool)
            close = np.flatnonzero(np.diff(at) == 1)
            for k in close:  # runs of overlapping pairs are rare and short
                free[k + 1] = not free[k]
            at, where = at[free], where[free]
        if not len(at):
            break
        out[at] = t.pair_values[where]
        keep = np.ones(len(out), bool)
        keep[at + 1] = False
        out, rows = out[keep], rows[keep]
    return out, rows


def canonical_array(column: pa.Array, skeleton: bool = False) -> pa.Array:
    """Canonical form (or skeleton) of a string array; null stays null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = b"" if data is None else data.to_pybytes()[offsets[0] : offsets[-1]] if n else b""
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    octets = np.frombuffer(raw, np.uint8)
    begun = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
    ends = begun[offsets - offsets[0]] if n else np.zeros(1, np.int64)
    row = np.repeat(np.arange(n), np.diff(ends))
    out, rows = canonical_codes(codes, row, skeleton)
    text = out.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = np.select([out < 0x80, out < 0x800, out < 0x10000], [1, 2, 3], 4)
    lengths = np.bincount(rows, weights=width, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    new_offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    mask = None
    if column.null_count:
        mask = pa.py_buffer(np.packbits(np.asarray(column.is_valid()), bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(new_offsets.tobytes()), pa.py_buffer(text), mask, column.null_count)


def canonical_text(df: DataFrame, text: str, into: str = "canonical", keep: list[str] | None = None, skeleton: bool = False) -> DataFrame:
    """``df`` with the canonical form of column ``text`` (or its skeleton) in column ``into``.

    Null gives null, the empty text the empty text; texts of any length are taken whole; other columns (those in
    ``keep``, by default all) are carried along, and a column that is named like ``into`` already is replaced. A narrow
    pass without a shuffle.
    """
    ship(df.sparkSession)
    names = [c for c in (keep if keep is not None else df.columns) if c != into]
    df = df.select(*dict.fromkeys([*names, text]))
    at = df.columns.index(text)
    schema = T.StructType([*(f for f in df.schema.fields if f.name in names), T.StructField(into, T.StringType())])
    kept = [df.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, PIECE_BYTES):
                out = canonical_array(part.column(at), skeleton).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), out], names=[*names, into])

    return df.mapInArrow(run, schema)


#: Parts that the rows of one spelling are spread over in the joins.
SALTS = 16


def _spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, form, spelling``: hashes of the skeleton and of the text as stored, written once; never texts."""
    hashes = canonical_text(df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()), text, "__form", skeleton=True)
    return materialize(hashes.select(key, F.md5(F.col("__form").cast("binary")).alias("form"), F.md5(F.col(text).cast("binary")).alias("spelling")), "forms")


def _salts(count: int = SALTS):
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of rows whose texts are displayed alike but are different strings: ``<key>_1 < <key>_2``.

    Rows with null text or null key are in no pair; identical strings make no pair, each copy pairs with each other
    spelling. What is shuffled are hashes, never texts. Spellings are made distinct by a map-side combined aggregation
    before they are paired, so copies of one text never meet each other; a form that only one spelling has - be it a third
    of all rows - pairs with nothing. The spellings of a form, and the rows of a spelling, meet in salted parts.
    ``lookalike_classes`` gives the same without listing pairs.
    """
    hashes = _spellings(df, key, text)
    spellings = hashes.select("form", "spelling").distinct()
    several = spellings.groupBy("form").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low <> high").select("form")
    several = spellings.join(several, "form", "left_semi")
    salt = lambda column: F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")
    ours = several.select("form", F.col("spelling").alias("s1"), salt("spelling"))
    pairs = ours.join(several.select("form", F.col("spelling").alias("s2"), _salts().alias("salt")), ["form", "salt"]).where("s1 < s2").select("s1", "s2")
    salted = hashes.select(key, "spelling", salt(key))
    first = pairs.withColumn("salt", _salts()).join(salted.select(F.col(key).alias("a"), F.col("spelling").alias("s1"), "salt"), ["s1", "salt"]).drop("salt")
    both = first.withColumn("salt", _salts()).join(salted.select(F.col(key).alias("b"), F.col("spelling").alias("s2"), "salt"), ["s2", "salt"])
    return both.select(F.least("a", "b").alias(f"{key}_1"), F.greatest("a", "b").alias(f"{key}_2")).where(F.col(f"{key}_1") < F.col(f"{key}_2")).distinct()


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text is displayed like another string of the table: ``key, class, n_spellings, n_links``.

    ``class`` is that of all texts displayed alike, ``n_links`` the number of rows in it that are spelled otherwise. Rows with null
    text or null key have no class. Rows are counted before they are joined, and join in salted parts; no pair is formed.
    """
    hashes = _spellings(df, key, text)
    counts = hashes.groupBy("form", "spelling").agg(F.count("*").alias("n"))
    classes = counts.groupBy("form").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings")).where("n_spellings > 1")
    links = counts.join(classes, "form").select("form", "spelling", "n_spellings", (F.col("n_rows") - F.col("n")).alias("n_links"), _salts().alias("salt"))
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return salted.join(links, ["form", "spelling", "salt"]).select(key, F.col("form").alias("class"), "n_spellings", "n_links")
