"""Generated, minified, vendored source files and data saved as code.

Each distinct file is described by numbers that don't depend on its words: how well it compresses, the entropy of its
tokens, the lengths of its identifiers, the share of comments, and how much of it is literal data or lines of one
pattern. A random forest learns from them which files weren't written by hand. Its labels come from notices comment
lines (``Code generated by ...``; mostly in the header) and in the file name (``.min.``, ``.pb.``); header, notices and
name are hidden from the features, so that the forest also finds the files that lost their notice, and minified ones. Two kinds
are decided by an exact check: copies of other projects look like any hand-written code, so a notice of their origin, a
third-party folder, or recurring in several repositories tells them; and data saved as code has no notices to learn
from, so the share of the text that is data tells it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship
from ..operators.batches import REMEMBERED, pieces

FEATURES = (
    "compression_ratio",  # compressed bytes to bytes of the body
    "token_entropy",  # bits per token
    "token_variety",  # distinct tokens to tokens
    "identifier_mean",  # characters of an identifier
    "identifier_short",  # share of identifiers with up to two characters
    "identifier_digits",  # share of identifiers with digits in them
    "identifier_variety",  # distinct identifiers, digits masked, to identifiers
    "comment_density",  # characters in comment lines to all
    "space_share",  # white space to all characters
    "line_mean",  # log of characters a line
    "line_longest",  # log of the longest line
    "pattern_share",  # share of lines whose pattern, names and numbers masked, occurs three times or more
    "pattern_variety",  # distinct patterns to lines
    "digit_share",  # digits to all characters
    "literal_share",  # characters within rows of data (numbers, quoted or encoded values) to all
)

#: Notices of a tool that wrote the file, in a header comment.
GENERATED_NOTICE = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated (?:by|file|code|from|with)|\bcode generated\b|\bgenerated (?:by|from|on build|automatically|with|using) "
    r"|\bautomatically (?:generated|produced|created|written)|\bautogenerated\b|\bmachine-(?:written|generated)|\bdo not (?:edit|modify|touch|change)\b[^.;]*(?:generated|written by|produced|regenerate|overwritten)"
    r"|(?:generated|produced|written by `?[\w./-]+ --)[^.;]*\b(?:do not|don't) (?:edit|modify|touch|change)|\bdo not (?:edit|modify): (?:written|generated|produced)|\bregenerate (?:with|by|using)\b|\bhand edits are (?:overwritten|lost)|\bchanges will be (?:lost|overwritten)"
    r"|automatisch (?:erzeugt|generiert|erstellt)|generad[oa] (?:autom[áa]ticamente|por)|g[ée]n[ée]r[ée]e? (?:automatiquement|par)|gerad[oa] (?:automaticamente|por)|сгенерирован|автоматически созда|自動生成"
)
#: Notices of another project that the file was taken from.
ORIGIN_NOTICE = re.compile(
    r"(?i)\bvendored from\b|\bimported from upstream\b|\bsend fixes upstream\b|\borigin: [\w.-]+/[\w.-]+@[0-9a-f]{6,}|\b(?:bundled|vendored|verbatim|unmodified) copy of\b|\btaken verbatim from\b|\bcopied (?:unmodified|verbatim|unchanged)\b"
    r"|\blocal changes: none\b|\bcopied from https?://|\bsource: https?://\S+ at v?\d"
)
#: What takes the notice back.
DENIAL = re.compile(r"(?i)\b(?:was|were|once|originally)\b[^.]*generated[^.]*\b(?:now|since)\b|maintained by hand|checked by hand|no longer generated|not generated")
#: Third-party folders. A folder right below them names the project, so a file needs two more parts.
THIRD_PARTY = re.compile(
    r"(?:^|/)(?:vendor|_vendor|third_?party|third-party|3rd_?party|3rdparty|node_modules|bower_components|jspm_packages|external|externals|extern|deps|Godeps/_workspace|gems|site-packages|Pods|Carthage/Checkouts)/[^/]+/(?:.*/)?[^/]+$"
)
#: File names that tools give.
TOOL_NAME = re.compile(r"(?i)(?:[.-]min|[.-]pack|[.-]bundle|\.pb|_pb|_pb2|\.gen|_gen|\.generated|_generated|\.g|\.designer)\.[a-z]+$|(?:^|/)zz_generated\.[^/]+$")
_COMMENT_START = ("//", "#", "/*", "*", "--", ";", "<!--", '"""', "'''", "=begin", "(*")

#: Marks of the line that code was made from; they are no comments.
_LINE_MARK = re.compile(r"^(?:#|//|--|;)\s?line\s+(?:\S+:)?\d+\s*$")
_TOKEN = re.compile(r"[A-Za-z_$]\w*|\d+|[^\w\s]")
_COMMENT_LINE = re.compile(r"(?://|#(?!\[)|/?\*|--|;|%|<!--)")
_MASK = re.compile(r"[A-Za-z_$]\w*|\d+(?:\.\d+)?|[\"'][^\"']*[\"']")
_DATA_ROW = re.compile(
    r"^\s*[\[({]?\s*(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:e-?\d+)?|[\"'][^\"']*[\"']|null|nil|true|false)\s*(?:,|=>|:)\s*)+(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?|[\"'][^\"']*[\"']|null|nil|true|false)?\s*[\])}]?,?\s*$"
)
_ENCODED = re.compile(r"(?=[A-Za-z0-9+/=_\\x-]*\d)(?=[A-Za-z0-9+/=_\\x-]*[A-Z])[A-Za-z0-9+/=_\\x-]{40,}|(?:[0-9a-f]{2}){24,}")
_DIGITS = re.compile(r"\d+|(?<=_)[0-9a-f]{1,2}(?=_|$)")


def header_end(lines: list[str]) -> int:
    """Number of leading lines that are comments, blank, or an opening tag."""
    block = False
    for i, line in enumerate(lines):
        s = line.strip()
        if block:
            block = "*/" not in s and "-->" not in s and s != "=end"
            continue
        if not s or s in ("<?php", "<?php declare(strict_types=1);") or s.startswith("#!"):
            continue
        if s.startswith(("/*", "<!--", "=begin")):
            block = "*/" not in s and "-->" not in s
            continue
        if s.startswith(("#[", "#include", "#define")) or not s.startswith(("//", "#", "--", ";", "%")):
            return i
    return len(lines)


def describe(text: str) -> tuple[list[float], int]:
    """Features of a file and its notices: 1 generated, 2 taken from elsewhere, 0 none."""
    lines = text.split("\n")
    end = header_end(lines)
    notice = 0
    told: list[int] = []  # notices stand in the header, between definitions, or at the end
    for i, line in enumerate(lines):
        s = line.strip()
        if (i < end or _COMMENT_LINE.match(s)) and not DENIAL.search(s):
            kind = 1 if GENERATED_NOTICE.search(s) else 2 if ORIGIN_NOTICE.search(s) else 0
            if kind:
                told.append(i)
                notice = min(notice or kind, kind)
    hidden = set(told)
    kept = [line for i, line in enumerate(lines[end:], start=end) if i not in hidden]
    body = "\n".join(kept)
    if not body.strip():
        return [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0 if text.strip() else 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0], notice
    raw = body.encode("utf-8", "surrogatepass")
    octets = np.frombuffer(raw, np.uint8)
    n = len(octets)
    tokens = Counter(_TOKEN.findall(body))
    total = sum(tokens.values())
    counts = np.fromiter(tokens.values(), float, len(tokens))
    entropy = float(-(counts * np.log2(counts / total)).sum() / total) if total else 0.0
    names = {k: v for k, v in tokens.items() if k[0].isalpha() or k[0] in "_$"}
    uses = sum(names.values()) or 1
    masked = {_DIGITS.sub("0", k) for k in names}
    own = [s for s in kept if s.strip()]
    lengths = [len(s) for s in own]
    comment = literal = 0
    patterns: Counter = Counter()
    for s in own:
        stripped = s.strip()
        if _LINE_MARK.match(stripped):
            continue
        if stripped.startswith(_COMMENT_START) and not stripped.startswith("#["):
            comment += len(s)
            continue
        if len(s) > 30 and _DATA_ROW.match(s):
            literal += len(s)
        elif len(s) > 40:
            literal += sum(m.end() - m.start() for m in _ENCODED.finditer(s))
        patterns[hash(_MASK.sub("w", stripped))] += 1
    coded = sum(patterns.values()) or 1
    chars = sum(lengths) or 1
    return [
        len(zlib.compress(raw, 1)) / n,
        entropy,
        len(tokens) / max(1, total),
        sum(len(k) * v for k, v in names.items()) / uses,
        sum(v for k, v in names.items() if len(k) <= 2) / uses,
        sum(v for k, v in names.items() if not k.isalpha() and any(c.isdigit() for c in k)) / uses,
        len(masked) / uses,
        comment / chars,
        float(np.isin(octets, (9, 10, 13, 32)).sum()) / n,
        math.log1p(chars / len(own)),
        math.log1p(max(lengths)),
        sum(v for v in patterns.values() if v >= 3) / coded,
        len(patterns) / coded,
        float(((octets >= 48) & (octets <= 57)).sum()) / n,
        literal / chars,
    ], notice


def file_features(df: DataFrame, path: str, content: str, repo: str | None = None) -> DataFrame:
    """A row for each distinct (path, content): ``path, repo, body_hash, name_notice, third_party, notice, features``.

    The rows of a file repeat its content: a task describes each content once and tells the rest by their hash, so no text
    is shuffled; what is left of the repetition, one small row a task, is made distinct afterwards. Null contents have no
    row; an empty text has one. ``body_hash`` is the same for files that differ in white space only; ``repo`` is the first
    part of the path.
    """
    ship(df.sparkSession)
    schema = T.StructType(
        [
            T.StructField(path, T.StringType()),
            T.StructField("repo", T.StringType()),
            T.StructField("body_hash", T.StringType()),
            T.StructField("name_notice", T.BooleanType()),
            T.StructField("third_party", T.BooleanType()),
            T.StructField("notice", T.IntegerType()),
            T.StructField("features", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow = pa.schema([(path, pa.string()), ("repo", pa.string()), ("body_hash", pa.string()), ("name_notice", pa.bool_()), ("third_party", pa.bool_()), ("notice", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

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
                rows = []
                for i, text in zip(fresh, part.column(2).take(pa.array(fresh)).to_pylist(), strict=True):
                    features, notice = describe(text)
                    plain = re.sub(r"^\./", "", (names[i] or "").replace("\\", "/"))
                    squeezed = hashlib.md5("".join(text.split()).encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((names[i], plain.split("/")[0], squeezed, bool(TOOL_NAME.search(plain)), bool(THIRD_PARTY.search(plain)), notice, features))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    files = df.where(F.col(content).isNotNull()).select(F.col(path).cast("string").alias(path), F.xxhash64(content).alias("__hash"), F.col(content))
    return files.mapInArrow(run, schema).dropDuplicates([path, "body_hash"])


#: Share of a file's characters within rows of data from which it is mainly data.
MAINLY_DATA = 0.75
#: Parts that the files of one content are spread over in a join.
SALTS = 16
#: Bound of the sample that the forest is fitted on; both classes are sampled at one rate, so their shares stay.
SAMPLE = 20_000
#: Weight of a file with a notice; of those without one many only lost theirs.
LABEL_WEIGHT = 3.0
#: In the second fit a file keeps its label if the first fit gives it at least this (with a notice) or less (without).
RELIABLE = 0.2


def _feature(name: str):
    return F.col("features")[FEATURES.index(name)]


def fit_forest(files: DataFrame, sample: int = SAMPLE, trees: int = 60, depth: int = 8, seed: int = 7):
    """A random forest over the labelled files of ``file_features``; None where one of the classes has no file.

    A file without a notice may well be generated, and one with a notice may look like any other, so the forest is fitted
    twice: the second fit is on the files whose looks agree with their label in the first one. Files of other projects, and those that are mainly data by their share of it, are left out, as their text tells nothing; of
    files with the same body one is taken. The fit is on at most about ``sample`` files, chosen by hash; everything but the
    fit covers all files.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = (
        files.where((F.col("notice") != 2) & ~F.col("third_party") & (_feature("literal_share") < MAINLY_DATA))
        .select("body_hash", "features", ((F.col("notice") == 1) | F.col("name_notice")).cast("double").alias("label"))
        .groupBy("body_hash")
        .agg(F.max("label").alias("label"), F.first("features").alias("features"))
    )
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    per_million = min(1_000_000, sample * 1_000_000 // sum(size.values()))
    chosen = F.pmod(F.xxhash64("body_hash"), F.lit(1_000_000)) < per_million
    train = known.where(chosen).select(array_to_vector("features").alias("x"), "label", F.when(F.col("label") == 1, LABEL_WEIGHT).otherwise(1.0).alias("w")).coalesce(2).cache()  # bounded by the sample
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed)
    agrees = (F.col("label") == 1) == (vector_to_array("probability")[1] >= RELIABLE)
    reliable = forest.fit(train).transform(train).where(agrees).select("x", "label", "w").cache()
    model = forest.fit(reliable) if reliable.select("label").distinct().count() == 2 else None
    train.unpersist()
    reliable.unpersist()
    return model


def not_handwritten(df: DataFrame, path: str, content: str, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Distinct files that weren't written by hand for their repository: ``path, reason, probability``.

    ``reason`` is ``vendored`` (a notice of origin, a third-party folder, or the same content in several repositories), ``data``
    (by its share), ``forest`` where the forest's probability says so, or ``notice`` of files that have a notice of generation but
    look like any other to the forest; ``probability`` is the forest's in any case. Null contents give nothing, an empty file no case; rows that repeat a file count once; other columns are ignored; an empty table gives an empty one.

    One pass over the text writes a row of numbers for each file; all else runs on these. Repeated contents are found by a
    map-side combined min and max of the repository, so a content that a third of all files has is no hot group.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    files = materialize(file_features(df, path, content), "files")
    model = fit_forest(files, sample)
    if model is None:
        scored = files.withColumn("probability", F.lit(0.0))
    else:
        scored = model.transform(files.withColumn("x", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1])
    entropy = _feature("token_entropy")
    recurring = files.where(entropy > 0).groupBy("body_hash").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("body_hash", F.lit(True).alias("recurs"))
    # the rows of one content are spread over salted parts
    recurring = recurring.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = scored.withColumn("salt", F.pmod(F.hash(path), F.lit(SALTS)))
    reason = (
        F.when((F.col("probability") >= threshold) & (entropy > 0), "forest")
        .when(F.col("notice") == 1, "notice")
        .when((F.col("notice") == 2) | F.col("third_party") | F.col("recurs"), "vendored")
        .when(_feature("literal_share") >= MAINLY_DATA, "data")
    )
    return scored.join(recurring, ["body_hash", "salt"], "left").select(path, reason.alias("reason"), F.round("probability", 6).alias("probability")).where("reason IS NOT NULL")
