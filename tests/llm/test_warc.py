from tremorlake.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, body string"


def resolved(spark, rows):
    return {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}


def full(i, url, ts, digest="d", status=200, **headers):
    return (i, url, ts, "response", status, {k.replace("_", "-"): v for k, v in headers.items()}, digest, f"body {i}")


def again(i, url, ts, **headers):
    return (i, url, ts, "revisit", 304, {k.replace("_", "-"): v for k, v in headers.items()}, None, None)


def test_latest_earlier_full_response(spark):
    rows = [
        full(1, "http://A.com", 10, etag='"x"'),
        full(2, "https://a.com:443/", 20, etag='W/"y"', Content_Length="5"),
        full(3, "https://a.com/", 25, status=206, etag='"z"'),
        full(4, "https://a.com/", 30, etag='"late"'),
        again(5, "https://a.com/#f", 30, ETag='"y"', Date="now", Content_Length="0"),
        again(6, "https://a.com/", 15, etag='"y"'),
        again(7, "https://a.com/", 10, etag='"x"'),
        again(8, "https://b.com/", 99, etag='"x"'),
        again(9, None, 99, etag='"x"'),
        again(10, "https://a.com/", None, etag='"x"'),
        again(11, "https://a.com/", 21),
    ]
    got = resolved(spark, rows)
    assert got[5].refers_to == 2 and got[5].outcome == "resolved"
    assert got[5].headers == {"content-length": "5", "date": "now", "etag": '"y"'}
    assert {i: r.outcome for i, r in got.items() if i != 5} == {
        6: "etag_differs", 7: "no_earlier_response", 8: "no_earlier_response", 9: "no_earlier_response", 10: "no_earlier_response", 11: "no_common_validator",
    }


def test_one_url_over_many_ranges(spark):
    rows = []
    for k in range(3000):
        rows.append(full(k, "http://hot/", 10 * k, last_modified=f"t{k // 500}") if k % 500 == 0 else again(k, "http://hot/", 10 * k, last_modified=f"t{k // 500}"))
    got = resolved(spark, rows)
    assert all(r.refers_to == i // 500 * 500 and r.outcome == "resolved" for i, r in got.items())


def test_ties_repeats_and_payloads(spark):
    rows = [full(1, "u", 5, etag="a"), full(2, "u", 5, etag="b"), again(3, "u", 6, etag="b"), again(3, "u", 6, etag="b")]
    frame = spark.createDataFrame(rows, SCHEMA)
    made = warc.with_payloads(warc.resolve_revisits(frame), frame, "body").collect()
    assert [(r.refers_to, r.body) for r in made] == [(2, "body 2")] * 2
    assert warc.resolve_revisits(frame.limit(0)).count() == 0
