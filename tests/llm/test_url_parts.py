from quarrylens.llm import url_filter


def _pages(spark):
    hosts = [f"h{i}.d{i % 700}.example" for i in range(6000)]
    urls = [(i, f"http://{h}/x") for i, h in enumerate(hosts)] + [(6000, None), (6001, "no host"), (6002, "http://H5.D5.EXAMPLE?q"), (6002, "http://H5.D5.EXAMPLE?q")]
    listed = [f"h{i}.d{i % 700}.example" for i in range(0, 6000, 4)] + [f"d{i}.example" for i in range(0, 700, 7)] + [f"absent{i}.example" for i in range(3000)] + [None]
    return spark.createDataFrame(urls, "page_id long, url string"), listed


def _brute(pages, listed):
    known = {k for k in listed if k}
    out = []
    for r in pages.collect():
        host = r.url.split("://", 1)[1].split("/")[0].split("?")[0].lower() if r.url and "://" in r.url else ""
        parts = host.split(".")
        out.append((r.page_id, any(".".join(parts[i:]) in known for i in range(len(parts)))))
    return sorted(out)


def test_thousands_of_keys_in_one_cascade(spark):
    pages, listed = _pages(spark)
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    got = url_filter.judge_urls(pages, rules=[], listed=keys)
    assert sorted((r.page_id, r.listed) for r in got.collect()) == _brute(pages, listed)
    universe = spark.createDataFrame([(f"u{i}",) for i in range(20_000)], "key string")
    assert len(url_filter.build_cascade(keys, universe)) >= 3


def test_long_lists_are_split_into_parts(spark):
    pages, listed = _pages(spark)
    assert url_filter.parts_needed(4600, 9400, 2048) == 4
    got = url_filter.judge_urls(pages, rules=[], listed=spark.createDataFrame([(k,) for k in listed], "key string"), max_bytes=2048)
    assert sorted((r.page_id, r.listed) for r in got.collect()) == _brute(pages, listed)


def test_parts_cover_a_long_universe(spark):
    assert url_filter.parts_needed(3, 10**9, 8 << 20) == 4
    assert url_filter.parts_needed(0, 0, 8 << 20) == 1
