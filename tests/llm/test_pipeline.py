import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import frame, rows
from tests.llm.test_text_operators import plain_groups, plain_targets
from tidewater.llm import mixing, quality
from tidewater.llm.common import ROW, numbered


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = docs.persist()
            assert docs.count() > 0
    got = docs.collect()
    assert all(r.round_trips and len(r.ids) == r.n_tokens for r in got)


def test_run_equals_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    again = corpus_pipeline.run(spark, small)
    rows = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert rows(got) == rows(again)


def hostile(spark, some=None):
    """Rows of the operators' fixtures, with a column more than documents has."""
    return frame(spark, some).select("doc_id", "text", "lang", "source", "n_chars", "id")


def test_stages_survive_hostile_rows(spark, small):
    docs = hostile(spark)
    columns, ids = docs.columns, {r[0] for r in rows()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, small)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == columns, name
        found = [r.doc_id for r in got.collect()]
        assert found and set(found) <= ids, name
    data = rows()
    kept = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in corpus_pipeline.distinct(spark, docs, small).collect())
    assert kept == Counter({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in data})
    near = corpus_pipeline.apart(spark, docs, small).collect()
    assert len(near) == len(set(plain_groups([r[1] for r in data])))


def test_stages_of_nothing_give_nothing(spark, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, hostile(spark, []), small).count() == 0, name


def test_copies_leave_one_and_clean_texts_stay(spark, small):
    prose = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    prose = list(dict.fromkeys(prose))
    spaced = [x.replace(" ", "  ") for x in prose]
    docs = frame(spark, [(i, t, "en", "a", None, *["x"] * 5) for i, t in enumerate(prose + spaced + prose)])
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact_dedup"](spark, docs, small).collect()
    assert {r.doc_id for r in exact} == set(range(len(prose), 2 * len(prose)))  # the longest of every text stays
    near = stages["near_dedup"](spark, docs, small).collect()
    groups = plain_groups(prose)
    assert sorted(r.doc_id for r in near) == sorted(set(groups))


def nameless(spark, small):
    """Clean texts without near copies whose ids are null or all the same, and the small table's documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = random.Random(11)
    prose = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 90))) for _ in range(40)]
    return docs, prose, frame(spark, [(None if i % 2 else 7, t, "en", "a", None, *["x"] * 5) for i, t in enumerate(prose)])


def test_dedup_stages_keep_clean_rows_of_null_and_repeated_ids(spark, small):
    _, prose, docs = nameless(spark, small)
    again = docs.union(frame(spark, [(3, prose[0], "en", "a", None, *["x"] * 5)]))
    for name in ("exact_dedup", "near_dedup"):
        stage = dict(corpus_pipeline.STAGES)[name]
        assert sorted(r.text for r in stage(spark, again, small).collect()) == sorted(prose), name


def test_near_dedup_chains_do_not_meet_at_a_shared_id(spark, small):
    rng = random.Random(11)
    words, other = ([f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(2))
    near = " ".join([*words[:200], "changed", *words[201:]])
    docs = frame(spark, [(i, t, "en", "a", None, *["x"] * 5) for i, t in [(7, " ".join(words)), (7, " ".join(other)), (3, near)]])
    assert sorted(r.text for r in corpus_pipeline.apart(spark, docs, small).collect()) == sorted([near, " ".join(other)])


def test_near_dedup_takes_similar_texts_and_leaves_others(spark, small):
    """Copies with a word in fifty changed go (similarity about 0.82), those with one in fifteen (about 0.55) stay."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    change = lambda step: " ".join("changed" if i % step == step - 1 else w for i, w in enumerate(words))
    docs = frame(spark, [(i, t, "en", "a", None, *["x"] * 5) for i, t in [(5, " ".join(words)), (6, change(50)), (7, change(15))]])
    assert sorted(r.doc_id for r in corpus_pipeline.apart(spark, docs, small).collect()) == [5, 7]


def test_quality_judges_each_row_without_id_by_its_own_text(spark, small):
    docs, _, _ = nameless(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    both = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    kept = quality.keep_good(both, labels).collect()
    by_id = Counter(r.text for r in kept if r.doc_id is not None)
    assert 0 < by_id.total() < docs.count()
    assert Counter(r.text for r in kept if r.doc_id is None) == by_id


def test_each_good_row_without_id_stays(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    score = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    kept = Counter(r.text for r in quality.keep_good(docs.withColumn("lang", F.lit(None).cast("string")), labels).collect())
    assert kept == Counter(r.text for r in docs.collect() if score[r.doc_id] == 1)


def test_mix_takes_each_row_by_its_own_copies(spark, small):
    """Rows without ids in three sources, and rows alike: as many come out as the mix decided on, source by source and size by size."""
    _, prose, docs = nameless(spark, small)
    more = [(None, prose[i % 40] + f" x{i % 9}", "en", f"s{i % 3}", None, *["x"] * 5) for i in range(90)]
    docs = docs.union(frame(spark, [(1, prose[3], "en", "b", None, *["x"] * 5)] * 5 + more))
    rows = numbered(docs)
    decided = mixing._deal(rows, "doc_id", "text", "source", mixing.WEIGHTS, mixing.SHARE, mixing.MOST, "mix", *ROW)
    want = Counter()
    for r in rows.join(decided.select(*ROW, "copies"), ROW).collect():
        want[r.doc_id, r.source, r.text] += r.copies
    got = mixing.take_mixed(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == +want
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(r.text.split())
    taken = Counter()
    for (_, source, text), n in want.items():
        taken[source] += n * len(text.split())
    for source, target in plain_targets(size).items():
        assert abs(taken[source] - target) <= 200
