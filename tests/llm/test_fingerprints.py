"""Fingerprints against bottom-k sketches in plain Python, and the estimates against exact shingle sets."""

import base64
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestream.llm import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def hashes(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    found = set()
    for i in range(max(len(words) - n + 1, 1) if words else 0):
        h = 42
        for w in words[i : i + n]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        found.add(struct.unpack("q", struct.pack("Q", h))[0])
    return found


def likeness(a, b, k=fingerprints.K):
    both = sorted(a | b)[:k]
    return len([h for h in both if h in a and h in b]) / len(both) if both else 1.0


def printed(found, k=fingerprints.K):
    return base64.b64encode(b"".join(struct.pack(">q", h) for h in sorted(found)[:k])).decode()


def brute(rows):
    """Of rows in their order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (sorted(hashes(t))[: fingerprints.K] for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(other), likeness(set(own), set(other)), likeness(set(own), set(after))))
    return out


def reported(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("tie", "no", "bucket", "after", "next", "sketch", "id", "n_chars", "edited")}).repartition(parts)
    got = fingerprints.fingerprint_report(df).drop("n_shingles").collect()
    return [tuple(r) for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]


def texts(seed, n):
    rng = random.Random(seed)
    words = [*(f"w{i}" for i in range(60)), "Été", "𝒳yz", "a,b", "UPPER"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 300])))
        rows.append((3 * i - 50, rows[-1][1] if rows and i % 7 == 0 else text))
    return rows


@pytest.mark.parametrize("bucket_rows", [7, 1024])
def test_every_row_against_plain_sketches(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    rows = [(None, "of no id  at all"), *texts(1, 150), (10_000, None), (10_001, ""), (10_002, " \t\n "), (10_003, " ".join(f"x{i * i % 3001}" for i in range(5000)))]
    assert reported(spark, rows) == brute(rows)


def test_many_rows_of_one_id_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    rows = [(1, "before all others here"), *[(2, "the same words again and again")] * 60, (3, "after all the others")]
    assert reported(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert reported(spark, []) == []
    for rows in ([(1, None)], [(5, "a row alone follows itself here")], [(1, "one two three"), (2, None)]):
        assert reported(spark, rows, 1) == brute(rows)


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    rng = random.Random(4)
    parts = [(i % 3, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(80)))) for i in range(40)] + [(None, "of no group at all here"), (7, None)]
    df = spark.createDataFrame(parts, "g long, text string").select("g", fingerprints.sketch(F.col("text")).alias("s"))
    got = {r.g: r.s for r in fingerprints.merged_by(df, "s", fingerprints.K, "g").collect()}
    want = {g: sorted(set().union(*(hashes(t) for h, t in parts if h == g)))[: fingerprints.K] for g in (0, 1, 2, 7, None)}
    assert got == want
    two = spark.createDataFrame([(parts[0][1], parts[3][1])], "a string, b string").select(fingerprints.merged(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("s")).first()
    assert two.s == sorted(hashes(parts[0][1]) | hashes(parts[3][1]))[: fingerprints.K]


def test_estimates_come_near_the_exact_shares(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(60):
        a = [f"w{rng.randrange(100000)}" for _ in range(rng.choice([100, 2000]))]
        pairs.append((" ".join(a), " ".join(a[: rng.randrange(1, len(a))] + [f"v{rng.randrange(100000)}" for _ in range(rng.choice([0, 500]))])))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[fingerprints.sketch(F.col(c)).alias(f"s{c}") for c in "ab"])
    got = df.select("a", "b", fingerprints.resemblance(F.col("sa"), F.col("sb")).alias("r"), fingerprints.containment(F.col("sb"), F.col("sa")).alias("c"), fingerprints.n_distinct(F.col("sa")).alias("n")).collect()
    off = {"r": [], "c": [], "n": []}
    for row in got:
        a, b = hashes(row.a), hashes(row.b)
        off["r"].append(abs(row.r - len(a & b) / len(a | b)))
        off["c"].append(abs((row.c if row.c is not None else 0.0) - len(a & b) / len(b)))
        off["n"].append(abs(row.n / len(a) - 1))
    assert max(off["r"]) < 0.2 and max(off["n"]) < 0.4  # within four and a half standard deviations
    assert sum(off["r"]) / 60 < 0.05 and sum(off["c"]) / 60 < 0.08 and sum(off["n"]) / 60 < 0.1
    empty = spark.createDataFrame([("", "a b")], "a string, b string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "ab"])
    row = empty.select(fingerprints.resemblance(F.col("a"), F.col("a")), fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.n_distinct(F.col("a"))).first()
    assert tuple(row) == (1.0, 0.0, None, 0.0)


def test_the_report_runs_no_python(spark):
    df = fingerprints.fingerprint_report(spark.createDataFrame(texts(2, 20), SCHEMA))
    assert "Python" not in df._jdf.queryExecution().toString()
