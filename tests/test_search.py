"""Pages and counts over the stored order of URLs, against the whole list."""

import random

import pytest


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    from stratarc.operators.searchindex import build_index, open_index

    r = random.Random(2)
    uris = {f"http://h{r.randrange(9)}.example/" + "/".join(r.choice(["a", "Bc", "th", "é"]) + str(r.randrange(40)) for _ in range(r.randrange(4))) for _ in range(900)}
    at = f"file://{tmp_path_factory.mktemp('index')}"
    build_index(spark.createDataFrame([(u,) for u in sorted(uris)] * 2 + [(None,)], "uri string"), at)
    return open_index(spark, at), sorted(((len([x for x in u.split("/")[3:] if x]), u) for u in uris), key=lambda x: (x[0], x[1].encode()))


def rows(df):
    return [(r.level, r.uri) for r in df.collect()]


@pytest.mark.parametrize("query", ["", "TH", "bc1", "none"])
def test_pages_and_counts(index, query):
    stored, whole = index
    want = [x for x in whole if query.lower() in x[1].lower()]
    assert stored.exact_count(query).first().total == len(want)
    assert rows(stored.found(query).orderBy("level", "uri")) == want
    for page in (1, 2, 5, 40, 10**9):
        k = min(page, 626) - 1
        assert rows(stored.offset_page(query, page)) == want[16 * k : 16 * k + 16]
    for at in (0, len(whole) // 3, len(whole) - 1):
        got = rows(stored.keyset_page(query, *whole[at]))
        assert got == [x for x in want if (x[0], x[1].encode()) > (whole[at][0], whole[at][1].encode())][:16]
    assert rows(stored.keyset_page(query, 1, None)) == want[:16]
    for cap in (1, 10, len(want) + 1):
        got = stored.capped_count(query, cap).first()
        assert (got.total, got.capped) == (min(len(want), cap), len(want) >= cap)


def test_deep_page_opens_no_part_before_its_cursor(spark, index, tmp_path):
    import shutil

    from stratarc.operators.searchindex import build_index, open_index

    _, whole = index
    build_index(spark.createDataFrame([(u,) for _, u in whole], "uri string"), f"file://{tmp_path}/i")
    stored = open_index(spark, f"file://{tmp_path}/i")
    assert len(stored.parts) == 4
    for part in (0, 1):
        shutil.rmtree(tmp_path / "i" / "uris" / f"part={part}")
    assert rows(stored.keyset_page("", *whole[-40])) == whole[-39:-23]
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
        stored.offset_page("", len(whole) // 16 - 2).collect()
