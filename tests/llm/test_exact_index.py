import hashlib

from quarrylens.llm import exact_dedup


def brute(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)


def test_shared_buckets_are_compared_once_more(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 500)
    texts = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    _, cells = exact_dedup.build_index(rows, capacity=8)
    assert max(r.spread for r in cells.collect()) > 2
    assert sorted(map(tuple, exact_dedup.exact_duplicates(rows, capacity=8).collect())) == brute(texts)


def test_owners_hold_ranges_of_keys(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 2000)
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    _, cells = exact_dedup.build_index(rows, capacity=16)
    owners = [r.owner for r in sorted(cells.collect(), key=lambda r: r.cell)]
    assert owners == sorted(owners) and len(set(owners)) > 4


def test_buckets_overflow_at_the_deepest_level(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_DEPTH", 2)
    texts = [(i, f"text {i // 2}") for i in range(400)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    index, _ = exact_dedup.build_index(rows, capacity=1)
    assert index.select("bucket").distinct().count() == 4 and index.count() == 200
    assert sorted(map(tuple, exact_dedup.exact_duplicates(rows, capacity=1).collect())) == brute(texts)


def test_owners_decide_between_texts_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 300)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.length(c).cast("long"))
    texts = [(i, f"text {i % 40:02}") for i in range(300)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    index, _ = exact_dedup.build_index(rows, capacity=1)
    assert sorted(r.chain for r in index.collect()) == list(range(1, 41))
    assert sorted(map(tuple, exact_dedup.exact_duplicates(rows, capacity=1).collect())) == brute(texts)
