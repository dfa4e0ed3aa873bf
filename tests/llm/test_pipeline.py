"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from barcraft.llm.sharding import SHARD_BYTES
from tests.llm.conftest import make_docs, text_of
from tests.llm.test_near_dedup import brute
from tests.llm.test_outputs import brute_mix, brute_shards, places
from tests.llm.test_texts import brute_hits, brute_quality


def good(text):
    m = brute_quality(text)
    from barcraft.llm.quality import GRAM_PERCENT, LINE_PERCENT

    base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    return not base and 100 * m["dup_line_chars"] <= LINE_PERCENT * m["word_chars"] and all(100 * m[f"dup{n}_chars"] <= p * m["word_chars"] for n, p in GRAM_PERCENT.items())


def test_every_stage_equals_brute_force_on_its_own_input(spark, sf_dir):
    """Rows are compared as multisets, so a stage that loses, adds or changes one fails."""
    current = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, items = current.columns, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows_of = lambda df: Counter(tuple(r) for r in df.collect())
    at = {c: i for i, c in enumerate(columns)}

    def step(name, want):
        nonlocal current
        out = stages[name](spark, current, sf_dir).cache()
        assert out.columns == columns and rows_of(out) == want, name
        current = out

    given = rows_of(current)
    good_rows = Counter({r: n for r, n in given.items() if good(r[at["text"]])})
    assert good_rows != given
    step("quality_rules", good_rows)
    groups = brute([(r[at["doc_id"]], r[at["text"]]) for r in good_rows], 80)
    alone = Counter({r: 1 for r in good_rows if groups[r[at["doc_id"]]][1] == r[at["doc_id"]]})
    assert len(alone) < len(good_rows)
    step("near_dedup", alone)
    clean = Counter({r: n for r, n in alone.items() if not brute_hits(r[at["text"]], items)[1]})
    assert len(clean) < len(alone)
    step("decontamination", clean)
    listed = places(current)
    want = brute_mix([(s, len((t or "").encode().split())) for _, t, s, _ in listed], [p for *_, p in listed])
    times = {listed[i][0]: v[1] for i, v in want.items()}
    mixed = Counter({r: n * times[r[at["doc_id"]]] for r, n in clean.items() if times[r[at["doc_id"]]]})
    assert max(mixed.values()) > 1
    step("source_mixing", mixed)
    shards = brute_shards([(r[at["doc_id"]], r[at["text"]]) for r in mixed.elements()], SHARD_BYTES)
    last = Counter((*r, f"b{name}") for r, (name, _) in zip(mixed.elements(), shards, strict=True))
    out = stages["sharding"](spark, current, sf_dir)
    assert out.columns == [*columns, "shard"] and rows_of(out) == last
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == last


def test_stages_take_empty_and_awkward_tables(spark, awkward, nothing, sf_dir):
    for docs in (nothing, awkward, make_docs(spark, [(1, text_of(1, 50))], extra=False)):
        current = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            following = stage(spark, current, sf_dir)
            assert following.columns == docs.columns, name
            assert following.schema.simpleString() == docs.schema.simpleString()
            current = following.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, current, sf_dir).count() == current.count()
