"""Cases that once failed: letters beyond the table of classes, writers during a vacuum, columns that cannot be kept."""

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import hashing, near_dedup, sharding, toxicity
from ratingloom.llm.common import hadoop_path


@pytest.mark.parametrize("insult, others", [("바보같은놈", "오늘 날씨가 좋다"), ("ばかやろう", "今日は いい 天気 です"), ("混蛋东西", "今天 天气 很 好"), ("𠮷𠮷野郎", "good day")])
def test_wide_letters(spark, insult, others):
    rows = [(i, f"{others} {insult} {i}" if i % 4 == 0 else f"{others} {i}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_in_parts(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert all((scores[i] > 0.5) == bool(toxic) for i, _, toxic in rows)


def test_classes():
    import numpy as np

    machine = toxicity.Automaton(toxicity.Lexicon({"aéz": 1.0, "바보": 1.0, "𠮷": 1.0}, {}))
    text = "aéz바보𠮷b가⿿　"
    got = machine.classes(np.array([ord(c) for c in text], np.int64))
    assert got.tolist() == [machine.letters.get(c, 0) for c in text]
    assert toxicity.Automaton(toxicity.Lexicon({}, {})).classes(np.array([0, 97, 50000])).tolist() == [0, 0, 0]


def test_beginnings_with_an_edit():
    machine = toxicity.Automaton(toxicity.Lexicon({}, {"zorgl": 2.0, "foo": 1.0}))

    def hit(word):
        state = 1
        for c in word:
            state = machine.step[state, machine.letters.get(c, 0)]
        return (machine.weight[state], int(machine.edits[state]))

    assert hit("zorgling") == (2.0, 0) and hit("food") == (1.0, 0)
    assert {hit(w) for w in ("zorrgling", "zargling", "zrgling", "xorgl", "zor_gl")} == {(2.0, 1)}
    assert {hit(w)[0] for w in ("zorging", "zorgs", "zzzorgl", "fo", "fxo", "plain")} == {0.0}


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 20)
    with pytest.raises(ValueError):
        toxicity.Automaton(toxicity.Lexicon({"worthless": 1.0, "someothers": 1.0}, {}))


def test_vacuum_leaves_a_writer_alone(spark, tmp_path):
    """What is written and not yet committed survives; a late writer cannot commit behind the latest version."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20, fanout=2, arrival_rows=5)
    rows = spark.range(20).select(F.col("id").alias("doc_id"))
    for _ in range(4):
        store.append(rows)
    store.compact()
    folder, late, onto = "data/of-a-writer", store.manifest(2), store.latest()
    rows.write.parquet(f"{store.root}/{folder}")
    assert store.vacuum() == 4 and store.vacuum() == 0
    fs, path = hadoop_path(spark, f"{store.root}/{folder}")
    assert fs.exists(path)
    store.commit(store.manifest(onto).union(store.describe(folder, onto + 1)), onto)
    assert store.read().count() == 100
    with pytest.raises(sharding.VersionTaken):
        store.commit(late, 2)
    with pytest.raises(ValueError, match="vacuumed"):
        store.read(2)


def test_metadata_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="_metadata"):
        sharding.ShardStore(spark, f"file://{tmp_path}/s").append(spark.createDataFrame([(1, "x")], "doc_id long, _metadata string"))


def test_deduplicate_keeps_columns_of_any_name_and_type(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (3, "other"), (None, "no id"), (None, "no id")], "doc_id long, text string")
    docs = rows.select("*", F.lit("x").alias("a.b"), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.lit("y").alias("_row"), F.lit("z").alias("select"), F.parse_json(F.lit('{"v":1}')).alias("v"))
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns and got.schema["m"].dataType == docs.schema["m"].dataType
    assert sorted((r.doc_id or 0, r["a.b"], tuple(r.m.items())) for r in got.collect()) == [(0, "x", (("k", None),)), (1, "x", (("k", 1),)), (3, "x", (("k", 3),))]


def test_shingles_of_very_few_words():
    """A batch of fewer words than a shingle has."""
    for n in range(8):
        for texts in ([b" ".join([b"w%d" % k for k in range(n)])], [b"", b" ".join([b"w"] * n), b"x"]):
            value, bounds = hashing.shingle_sets(texts, 5)
            sizes = [len({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}) if w else 0 for w in (t.split() for t in texts)]
            assert (bounds[1:] - bounds[:-1]).tolist() == sizes and len(value) == sum(sizes)


def test_models_of_other_kinds_go():
    """A worker holds the model of the kernel that runs, and no other."""
    from ratingloom.llm import common

    common.WORKER.clear()
    assert common.worker_model("a", lambda: 1) == 1 and common.worker_model("a", lambda: 2) == 1
    assert common.worker_model("b", lambda: 3) == 3 and list(common.WORKER) == ["b"]
    common.release_models("b")
    assert list(common.WORKER) == ["b"]
    assert list(common.text_chunks([], "text")) == [] and common.WORKER == {}


def test_batches_are_bounded_by_bytes(spark):
    """Long texts come in batches of a few megabytes."""
    import pyarrow as pa

    from ratingloom.llm import common

    common.bound_batches(spark)
    seen = spark.range(0, 60, 1, 1).select(F.col("id"), F.repeat(F.lit("x"), 1 << 20).alias("t")).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()
    assert len(seen) > 5 and max(r.n for r in seen) < 2 * common.BATCH_BYTES
