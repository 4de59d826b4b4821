import hashlib
from collections import Counter, defaultdict

from pyspark.sql import Row
from test_mixing import filled
from test_near_dedup import brute

import corpus_pipeline
from passageloom.llm import classifier, mixing, pieces
from passageloom.llm.common import held_out
from passageloom.llm.near_dedup import Settings, group_near_copies


def test_every_stage_does_its_work(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, table_dir).cache()
        seen[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns, name
            # Nothing comes in that wasn't there; nulls became empty texts at most.
            assert {(r.doc_id, r.text or "") for r in seen[name]} <= {(r.doc_id, r.text or "") for r in before.collect()}
    texts = [r.text for r in seen["exact_dedup"]]
    assert sorted(texts) == sorted({r.text or "" for r in seen["quality"]})
    assert all(c <= 3 for c in Counter((r.doc_id, r.text) for r in seen["mixing"]).values())
    model = pieces.loaded(open(pieces.MODEL, "rb").read())
    decoded = Counter((r.doc_id, model.decode(r.ids)) for r in seen["encode"])
    assert decoded == Counter((r.doc_id, r.text or "") for r in seen["mixing"])


def test_run_equals_its_stages(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, table_dir)
    assert Counter(map(str, corpus_pipeline.run(spark, table_dir).collect())) == Counter(map(str, docs.collect()))


def test_no_near_copies_are_left(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    left = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, docs, table_dir), table_dir)
    again = group_near_copies(left, settings=Settings()).collect()
    assert all(r.kept for r in again)


def test_a_lazy_result_outlives_other_stages(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    first = corpus_pipeline.exact(spark, docs, table_dir)
    second = corpus_pipeline.exact(spark, docs, table_dir)
    assert Counter(map(str, first.collect())) == Counter(map(str, second.collect()))


def test_run_leaves_what_its_result_reads(spark, table_dir):
    _, before = corpus_pipeline._folders(spark)
    out = corpus_pipeline.run(spark, table_dir)
    left = {folder.rpartition("/")[2].rpartition("-")[0] for folder in corpus_pipeline._folders(spark)[1] - before}
    assert "mixing" in left and not left & {"quality", "exact_dedup", "near_dedup", "documents", "shingles", "classes"}
    assert out.count()


def mixed_by_hand(rows):
    """The rows as often as fair queueing takes them, one copy at a time."""
    size = {i: len(r.text.encode().split()) for i, r in enumerate(rows)}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total_of = {s: sum(size[i] for i, r in enumerate(rows) if r.source == s) for s in names}
    target, queue = filled(total_of, mixing.WEIGHTS), []
    for rank, s in enumerate(names):
        key = lambda i: int(hashlib.md5(str("" if rows[i].doc_id is None else rows[i].doc_id).encode()).hexdigest()[:15], 16)
        at = 0
        own = sorted((i for i, r in enumerate(rows) if r.source == s), key=key)
        for i in own * 3:
            if size[i] and at < target[s]:
                queue.append(((at + size[i]) / target[s], rank, i))
            at += size[i]
    out, words = [], 0
    for _, _, i in sorted(queue):
        words += size[i]
        if words > sum(size.values()):
            break
        out.append(rows[i])
    return out


def test_every_stage_equals_brute_force(spark, table_dir, tmp_path):
    # The awkward rows and, so that quality has something to reject, labelled junk.
    junk = [(1000 + i, "click here | buy now | win $$$ " * (1 + i % 4) + f"x{i // 2}", "en", "s1", 9) for i in range(60)]
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    docs.union(spark.createDataFrame(junk, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{table_dir}/labels.parquet").filter("doc_id is not null and quality is not null")
    labels = labels.union(spark.createDataFrame([(r[0], 0, 0) for r in junk], labels.schema))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table_dir = str(tmp_path)
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    rows = docs.collect()

    def check(stage, docs, want):
        docs = stage(spark, docs, table_dir).cache()
        assert Counter(map(tuple, docs.collect())) == Counter(map(tuple, want))
        return docs

    labels = spark.read.parquet(f"{table_dir}/labels.parquet")
    scored = classifier.classify(docs, labels.filter(~held_out(labels["doc_id"], 4))).collect()
    scores = {r.doc_id: r.score for r in scored if r.doc_id is not None}
    by_text = {r.text or "": scores[r.doc_id] for r in rows if r.doc_id is not None}
    good = [r for r in rows if by_text[r.text or ""] >= 0.7]
    assert 0 < len(good) < len(rows)
    good_docs = check(corpus_pipeline.quality, docs, good)

    def one_of_each(rows):
        of_text = defaultdict(list)
        for r in rows:
            of_text[r.text or ""].append(r)
        # The largest id stays; a null id is smaller than any.
        last = [max(same, key=lambda r: (r.doc_id is not None, r.doc_id or 0)) for same in of_text.values()]
        return [Row(**{**r.asDict(), "text": r.text or ""}) for r in last]

    def one_of_near(rows):
        component = {doc: c for doc, _, c in brute([(r.doc_id, r.text) for r in rows], 80)}
        return [r for r in rows if r.doc_id == component[r.doc_id]]

    # As the stages meet the rows, and on all rows, where more copies are left.
    for at, own in ((good_docs, good), (docs, rows)):
        own = one_of_each(own)
        at = check(corpus_pipeline.exact, at, own)
        own = one_of_near(own)
        at = check(corpus_pipeline.near, at, own)
        check(corpus_pipeline.mix, at, mixed_by_hand(own))
