"""Secret scans: fixed patterns, and values in credential context by guess cost.

Base kinds are patterns: ``assign`` (a credential name, ``:`` or ``=``, a value of 12 or
more characters), ``access`` (access key ids) and ``hex`` (16 or more hex digits);
each takes leftmost matches that do not overlap and drops those that are too short.

``guess`` is what the method adds: any value in a wider credential context, also
short, quoted or with punctuation, whose cheapest explanation costs 10^10
guesses or more.  Dynamic programming finds the cheapest segmentation of the value
into words (by rank, with case and look-alike digits), dates and years,
repeats, keyboard walks and brute-force characters; a change of segment doubles
the cost.  So `changeme123`, `2024-05-01` or a word are left alone and a random
value is not.  A guess that overlaps a base span is not added again.

Words are the fixed list and, in Spark, the words of all documents in any language: a word
that occurs c times among N words outside credential values has rank N / c, as no more
words can be as common.  Values that the fixed list leaves in doubt are joined with the
counts of the words that stand in them, words of up to ``WHOLE`` letters as they are, longer
ones by their first ``WHOLE`` letters; the values that then cost less are cleared, and each text
gets the cleared values of its own.  Neither words nor values have a cap, and none
go to the driver.

Offsets are code points, the end exclusive.  A value's costs are found in time
proportional to its length.

Cases: a null or empty text has no spans; repeated rows are scanned each; other
columns are ignored, whatever their names; redacting keeps a null text null.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection
from hashlib import sha256
from itertools import accumulate
from math import comb, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnforge.llm.common import stored

KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?ai)(?:password|passwd|passphrase|pwd|secret|token|credential|(?:api|access|private|auth)_?key)["']?[\x20\t]*[:=][\x20\t]*(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"',;]+))""")
LEAST_COST = 10.0  # decimal logarithm of guesses
RUN = re.compile(r"[^\W\d_]{3,}")
WHOLE = 24  # letters by which longer words are looked up
FLUSH = 200_000  # words a task counts before it sends them
STARTS = 10_000  # places of a letter run whose strings are sent at once

# Words people put where a password goes, the commonest first (own choice).
WORDS = """password secret changeme admin token test example qwerty welcome letmein login user root key default
love dragon monkey master sunshine princess football baseball shadow superman batman hello freedom whatever
trustno ninja flower computer internet server database service account access public private master guest
demo sample dummy placeholder your here insert value string todo none null true false foo bar baz hunter
summer winter spring autumn monday friday january march june july august october december house orange
apple banana cookie coffee summer star blue green black white silver gold happy lucky magic music tiger
the and you for that with this from pass word my new old big api auth prod dev stage local host data""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = max(map(len, RANK))
LOOKS_LIKE = str.maketrans("@4013$57", "aaolesst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEXT |= {b + a for a, b in NEXT}
DATE = re.compile(r"(?a)(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)?\d\d)")
YEAR = re.compile(r"(?a)(?:19|20)\d\d")
SWITCH = log10(2)


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() else log10(33)


def _word_cost(word: str, known: dict[str, float] | None = None) -> float | None:
    low = word.lower()
    rank = RANK.get(low)
    if known and low in known:
        rank = min(rank or known[low], known[low])
    swapped = 0.0
    if rank is None:
        rank, swapped = RANK.get(low.translate(LOOKS_LIKE)), SWITCH
        if rank is None:
            return None
    upper = sum(c.isupper() for c in word)
    if upper in (0, len(word)) or (upper == 1 and word[0].isupper()):
        case = SWITCH if upper else 0.0
    else:
        ways = 0
        for k in range(1, min(upper, len(word) - upper) + 1):
            ways += comb(len(word), k)
            if ways > 10 ** LEAST_COST:  # a secret already
                break
        case = log10(ways)
    return log10(rank + 1) + swapped + case


def segments_from(value: str, i: int, run_end: int, walk_end: int, known: dict[str, float] | None = None, lengths: Collection[int] = range(3, LONGEST + 1)):
    """(end, cost) of the words (of the given lengths), dates, repeats and walks that begin at ``i``."""
    for length in lengths:
        if i + length > len(value):
            break
        cost = _word_cost(value[i:i + length], known)
        if cost is not None:
            yield i + length, cost
    if value[i].isdigit():
        if m := DATE.match(value, i):
            yield m.end(), log10(365 * 60 * 4)
        if m := YEAR.match(value, i):
            yield m.end(), log10(60)
    if run_end - i >= 3:
        yield run_end, _char_cost(value[i]) + log10(run_end - i)
    if walk_end - i >= 3:
        yield walk_end, log10(47 * 2) + log10(walk_end - i)


def guess_cost(value: str, known: dict[str, float] | None = None) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes; ``known``: ranks of words besides the fixed ones."""
    n = len(value)
    low = value.lower()
    run, walk = [n] * (n + 1), [n] * (n + 1)  # where the repeat and the walk that hold i end
    for i in range(n - 2, -1, -1):
        run[i] = run[i + 1] if value[i] == value[i + 1] else i + 1
        walk[i] = walk[i + 1] if low[i:i + 2] in NEXT else i + 1
    lengths = sorted({*range(3, LONGEST + 1), *map(len, known or ())})
    far = float("inf")
    brute, other = [far] * (n + 1), [far] * (n + 1)  # cheapest up to i, by the kind of the last segment
    other[0] = 0.0
    for i in range(n):
        best = min(brute[i], other[i])
        free = 0.0 if i == 0 else SWITCH
        brute[i + 1] = min(brute[i + 1], min(brute[i], other[i] + free) + _char_cost(value[i]))
        for j, cost in segments_from(value, i, run[i], walk[i], known, lengths):
            other[j] = min(other[j], best + free + cost)
    return min(brute[n], other[n])


def scan(text: str, cleared: Collection[str] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; ``cleared`` values are no guesses."""
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        taken = sorted((s, e) for _, s, e in found)
        starts, upto = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            free = upto[bisect_left(starts, end)] <= start  # no span that begins before the end reaches past the start
            if free and text[start:end] not in cleared and guess_cost(text[start:end]) >= LEAST_COST:
                found.append(("guess", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _key(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _doubtful(batches):
    """The values that the fixed words leave as guesses, by the key of their text."""
    for batch in batches:
        found = {(_key(text), text[start:end]) for text in batch.column(0).to_pylist() if text for kind, start, end in scan(text) if kind == "guess"}
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([_key(v) for _, v in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["text_key", "value_key", "value"])


def _parts(batches):
    """Strings of 3 to ``WHOLE`` letters in the values; a word of more letters begins with one of the longest."""
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run in RUN.findall(value.lower()):
                for lo in range(0, len(run), STARTS):
                    found = sorted({run[i:j] for i in range(lo, min(lo + STARTS, len(run))) for j in range(i + 3, min(len(run), i + WHOLE) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found, pa.string())], ["value_key", "part"])


def _count_words(batches):
    """Words outside credential values, as often as they stand there."""
    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(RUN.findall(CONTEXT.sub(" ", text).lower()))
                if len(seen) > FLUSH:
                    yield flush()
                    seen.clear()
    yield flush()


def _likely(batches):
    """The values that cost too little once the words of the documents are known."""
    for batch in batches:
        keys = [key for key, value, words in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                if guess_cost(value, {w["word"]: w["rank"] for w in words}) < LEAST_COST]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["value_key"])


def cleared_values(docs: DataFrame) -> DataFrame | None:
    """(text_key, cleared): the values of each text that are no secrets, as they are made of common words of all documents; None if no value is in doubt."""
    texts = docs.select("text")
    doubtful = stored(texts.mapInArrow(_doubtful, "text_key string, value_key string, value string").distinct(), "doubtful-values")
    if not doubtful.limit(1).count():
        return None
    counts = stored(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked = counts.select("word", (F.lit(total) / F.col("n")).alias("rank"))
    values = stored(doubtful.select("value_key", "value").distinct(), "values")
    parts = stored(values.mapInArrow(_parts, "value_key string, part string").distinct(), "value-parts")
    short = parts.join(ranked.withColumnRenamed("word", "part"), "part").select("value_key", F.col("part").alias("word"), "rank")
    longer = ranked.where(F.length("word") > WHOLE).withColumn("part", F.substring("word", 1, WHOLE))
    long = parts.where(F.length("part") == WHOLE).join(longer, "part").join(values, "value_key").where(F.contains(F.lower("value"), F.col("word"))).select("value_key", "word", "rank")
    words = short.union(long).groupBy("value_key").agg(F.collect_list(F.struct("word", "rank")).alias("words"))
    likely = values.join(words, "value_key").select("value_key", "value", "words").mapInArrow(_likely, "value_key string")
    return stored(doubtful.join(likely, "value_key", "left_semi").groupBy("text_key").agg(F.collect_set("value").alias("cleared")), "cleared-values")


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _with_cleared(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and, in column ``name``, the cleared values of each text."""
    cleared = cleared_values(docs)
    if cleared is None:
        return docs.withColumn(name, F.array().cast("array<string>"))
    key = _fresh(docs, "text_key")
    cleared = cleared.select(F.col("text_key").alias(key), F.col("cleared").alias(name))
    return docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256)).join(cleared, key, "left").drop(key).select(*(F.col(f"`{c}`") for c in docs.columns), name)


def _scanned(part: pa.RecordBatch, text: str, cleared: str) -> list[list[tuple[str, int, int]]]:
    return [scan(t or "", frozenset(c or ())) for t, c in zip(part.column(text).to_pylist(), part.column(cleared).to_pylist(), strict=True)]


def _scan_batches(cleared: str):
    def scan_all(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in _scanned(part, "text", cleared)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(spans, pa.list_(SPAN))], ["row", "spans"])
    return scan_all


def with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row and ``spans``, an array of (kind, start, end)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    got = _with_cleared(rows, "cleared").mapInArrow(_scan_batches("cleared"), f"row {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return got.select(*(F.col(f"row.`{c}`") for c in keep), "spans")


def listed(spans: str, base_only: bool = False) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"] != "guess") if base_only else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redact_batches(cleared: str):
    def redact_all(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, found in zip(batch.column(at).to_pylist(), _scanned(batch, "text", cleared), strict=True):
                pieces, upto = [], 0
                for _, start, end in found:
                    if start >= upto:
                        pieces += [text[upto:start], "[secret]"]
                    upto = max(upto, end)
                out.append("".join([*pieces, text[upto:]]) if pieces else text)
            kept = [n for n in batch.schema.names if n != cleared]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select(kept)
    return redact_all


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of overlapping secrets in ``text`` replaced by `[secret]`, all other columns as they were."""
    cleared = _fresh(docs, "cleared")
    return _with_cleared(docs, cleared).mapInArrow(_redact_batches(cleared), docs.schema)
