"""Small corpora with awkward rows."""

from __future__ import annotations

import pytest

#: Names that operators use inside; a table may have columns called so.
CLASHES = ["key", "h", "bands", "size", "label", "n", "hits", "bucket", "page", "bytes", "node", "comp", "start", "runs", "part", "prefix", "depth", "kept", "taken", "shard", "members", "digest", "fp1", "cell", "__copy", "passes", "toxic_score"]


def make_docs(spark, rows, extra=True):
    """rows of (doc_id, text[, lang[, source]]) as a documents table, with clashing columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHES)})
    return df


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def thue_morse(n: int) -> tuple[str, str]:
    """A Thue-Morse word over a and b and its complement: polynomial hashes modulo a power of two
    are equal on them from some length on, whatever their base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "two words"), (7, text_of(1, 60)), (7, text_of(1, 60)), (8, text_of(1, 60)), (None, text_of(1, 60)), (None, None),
    (9, text_of(2, 20_000)), (10, text_of(3, 40) + " naïve Éa ß 漢字 🙂"), (11, "x" * 70_000), (12, text_of(4, 50) + "\n" + text_of(5, 30)), (13, "   odd space"), (-3, text_of(6, 25)),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return make_docs(spark, AWKWARD).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
