"""Secret scans: patterns, plus a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import lean, materialize, small_batches, table

KINDS = ("assign", "access", "hex", "random")
# letters in either case are spelt out by ASCII matching, so that no other letter folds onto them
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYS = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Every access and hex secret lies inside one of these, so only they are searched for them.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B36 = "0123456789abcdefghijklmnopqrstuvwxyz"
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ENCODINGS = {"hex": HEX, "HEX": UPPER_HEX, "base32": B32, "base36": B36, "base62": B62, "base64": B62 + "+/", "base64url": B62 + "-_"}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}

#: Bounds of the bins of combined p-values; a threshold is one of them.
BINS = (0.0, 1e-12, 1e-9, 1e-7, 1e-6, 1e-5, 1e-4, 3e-4, 1e-3, 3e-3, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 1.0)
#: Share of text with p above 0.5, at a guess; runs of text that the first guess of their law counts for; rounds of fitting.
STRAY, GUESS, FITS = 0.005, 2.0, 60


def encoding_of(s: str) -> str | None:
    """The smallest alphabet that holds s, None if s has no digit and letter, or is of several parts.

    Without both letters and digits a run is a word or a number, not an encoding.
    Larger alphabets must also show both cases.
    """
    chars = set(s)
    digit = any("0" <= c <= "9" for c in chars)
    upper = any("A" <= c <= "Z" for c in chars)
    lower = any("a" <= c <= "z" for c in chars)
    if not digit or not (upper or lower):
        return None
    for name in ENCODINGS:
        if chars <= _SETS[name]:
            return name if len(ENCODINGS[name]) <= 36 or (upper and lower) else None
    return None


def _normal_tail(z: float) -> float:
    """P(|N| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(idx: list[int], size: int) -> float:
    """P of counts at least as uneven, were all symbols alike likely.

    Counts are sparse in short runs, so the statistic is referred to the gamma law
    that has its exact mean and variance, by Wilson and Hilferty's cube root.
    """
    n = len(idx)
    counts: dict[int, int] = defaultdict(int)
    for i in idx:
        counts[i] += 1
    stat = sum(c * c for c in counts.values()) * size / n - n
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    shape = mean * mean / var
    z = ((stat / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape)
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(idx: list[int], size: int) -> float:
    """Wald and Wolfowitz: runs of symbols in the lower and upper half of the alphabet."""
    half = [2 * i >= size for i in idx]
    n1 = sum(half)
    n0 = len(half) - n1
    if not n0 or not n1:
        return 2.0 ** (1 - len(half))
    runs = 1 + sum(a != b for a, b in zip(half, half[1:], strict=False))
    mean = 1 + 2 * n0 * n1 / (n0 + n1)
    var = (mean - 1) * (mean - 2) / (n0 + n1 - 1)
    return _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(idx: list[int]) -> float:
    """Correlation of each symbol's place in the alphabet with the next one's."""
    n, m = len(idx), sum(idx) / len(idx)
    var = sum((i - m) ** 2 for i in idx)
    if not var:
        return 0.0
    r = sum((a - m) * (b - m) for a, b in zip(idx, idx[1:], strict=False)) / var
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def battery_p(s: str, name: str) -> float:
    """Fisher's combination of the three tests: about uniform for random strings, near 0 for text."""
    at = _INDEX[name]
    idx = [at[c] for c in s]
    x = -sum(math.log(max(p, 1e-300)) for p in (chi_squared_p(idx, len(at)), runs_p(idx, len(at)), serial_p(idx)))
    return math.exp(-x) * (1 + x + x * x / 2)


def length_class(n: int) -> int:
    """20-23, 24-31, 32-47, 48-63, 64-127, 128 and more."""
    return sum(n >= x for x in (24, 32, 48, 64, 128))


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int, float]]]:
    """(base spans (start, kind, end), candidates (start, end, encoding, length class, p)) of a whole text; offsets in code points."""
    base: list[tuple[int, int, int]] = []
    found: list[tuple[int, int, str, int, float]] = []
    if not text:
        return base, found
    if _KEYS.search(text):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        # no letter or digit outside the run can lengthen these
        base += [(at + a.start(), 1, at + a.end()) for a in _ACCESS.finditer(run) if len(a[0]) >= 20]
        base += [(at + h.start(), 2, at + h.end()) for h in _HEX.finditer(run)]
        core = run.rstrip("=")  # padding; what stands before another "=" is a name
        cut = core.rfind("=") + 1
        core = core[cut:]
        if len(core) >= 20 and (name := encoding_of(core)):
            found.append((at + cut, m.end(), name, length_class(len(core)), battery_p(core, name)))
    base.sort()
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def free(start: int, stop: int) -> bool:
        k = bisect_left(starts, stop)  # of the spans that begin before it stops, one may end after it starts
        return not k or furthest[k - 1] <= start

    return base, [c for c in found if free(c[0], c[1])]


def _falling(mass: list[float]) -> list[float]:
    """The law over bins, nearest to mass by weighted squares, whose density falls as p rises; above 0.5 it is STRAY."""
    blocks: list[list[float]] = []  # mass, width, bins
    for m, w in zip(mass[:-1], WIDTHS[:-1], strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] < blocks[-1][0] / blocks[-1][1]:
            m, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + m, blocks[-1][1] + w, blocks[-1][2] + n]
    density = [m / w for m, w, n in blocks for _ in range(n)]
    total = sum(d * w for d, w in zip(density, WIDTHS, strict=False))
    return [d * w / total * (1 - STRAY) for d, w in zip(density, WIDTHS, strict=False)] + [STRAY]


WIDTHS = [b - a for a, b in zip(BINS, BINS[1:], strict=False)]
#: The first guess of text's law: even over the decades of p.
TEXT = _falling([3.0, *(math.log10(b / a) for a, b in zip(BINS[1:], BINS[2:-1], strict=False)), 0.0])


def thresholds(counts: dict[tuple[str, int], list[int]], q: float) -> dict[tuple[str, int], float]:
    """The least p from which a run counts as random, for each encoding and length class.

    A run is random, and then its p is uniform, or text, and then p is near 0, the nearer, the longer it is. The law of
    text's p is fitted for each length class over all its encodings, since one class may have few runs, together with
    the share of text in each class (expectation and maximisation; a class's share starts from one run of
    either kind, so without evidence neither is certain). That gives each bin of a class the chance that its runs are text.
    The bound is the least at which that chance is at most one half, and at most q on average over all runs above it: the
    false-discovery rate is held in each class by itself. Nor may the runs above it exceed by more than q of them what the
    number above 0.5, and a standard deviation of it, lets expect of random ones: so copies of one text, which no
    falling law describes, are not taken for random. Where no bound will do, it is above 1.
    """
    text_law = {n: TEXT for _, n in counts}
    text: dict[tuple[str, int], list[float]] = {}
    share = dict.fromkeys(counts, 0.5)
    for _ in range(FITS):
        for key, n in counts.items():
            law, x = text_law[key[1]], share[key]
            text[key] = [x * g / (x * g + (1 - x) * u) for g, u in zip(law, WIDTHS, strict=True)]
            share[key] = (1 + sum(a * b for a, b in zip(n, text[key], strict=True))) / (2 + sum(n))
        for size in text_law:
            own = [key for key in counts if key[1] == size]
            text_law[size] = _falling([GUESS * g + sum(counts[key][i] * text[key][i] for key in own) for i, g in enumerate(TEXT)])
    out = {}
    for key, n in counts.items():
        out[key], wrong, above = 2.0, 0.0, 0
        for i in range(len(BINS) - 2, 0, -1):
            wrong, above = wrong + n[i] * text[key][i], above + n[i]
            usual = 2 * (n[-1] + math.sqrt(n[-1])) * (1 - BINS[i])
            if text[key][i] > 0.5 or max(wrong, above - usual) > q * above:
                break
            out[key] = BINS[i]
    return out


SCANNED = "doc_id long, base array<struct<start:int,kind:int,stop:int>>, more array<struct<start:int,stop:int,enc:string,len:int,p:double>>"


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every row's whole text."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("enc", pa.string()), ("len", pa.int32()), ("p", pa.float64())]))
        for b in batches:
            base, more = [], []
            for x in b.column(1):
                s, c = scan(x.as_py())
                base.append([dict(zip(("start", "kind", "stop"), y, strict=True)) for y in s])
                more.append([dict(zip(("start", "stop", "enc", "len", "p"), y, strict=True)) for y in c])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(more, cand)], ["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCANNED)


def find_secrets(docs: DataFrame, q: float = 0.1) -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<start, kind, stop>> by start, then kind; base ones and random ones.

    Null and empty texts have none. Other columns are ignored, whatever their names; repeated rows give a row each. The counts from which
    the bounds derive cover all documents: one row per encoding, length class and bin.
    """
    s = materialize(scanned(docs), "secrets")
    c = s.select(F.explode("more").alias("c"))
    bin_of = sum((F.col("c.p") >= b).cast("int") for b in BINS[1:-1])
    counts: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0] * (len(BINS) - 1))
    # at most 7 encodings x 6 classes x 24 bins
    for r in c.select("c.enc", "c.len", bin_of.alias("bin")).groupBy("enc", "len", "bin").count().collect():
        counts[r["enc"], r["len"]][r["bin"]] = r["count"]
    bounds = thresholds(counts, q)
    limit = F.create_map(*(x for (enc, n), p in bounds.items() for x in (F.lit(f"{enc}:{n}"), F.lit(p)))) if bounds else None
    random = F.filter("more", lambda m: m["p"] >= F.element_at(limit, F.concat(m["enc"], F.lit(":"), m["len"].cast("string")))) if bounds else F.filter("more", lambda m: F.lit(False))
    random = F.transform(random, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["stop"].alias("stop")))
    return s.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base spans counted by kind, and all spans with the random ones."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = {k: F.size(F.filter("base", (lambda i: lambda x: x["kind"] == i)(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])}
    return found.select("doc_id", *n.values(), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def base_digest(text: str | None) -> str:
    """What base_sha256 must be, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in scan(text)[0]).encode()).hexdigest()


QUERIES = {"op1_secrets": op1_secrets}
ORACLE_SQL: dict[str, str] = {}
