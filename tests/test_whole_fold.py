from spanlab.plans import more, views


def test_fold_of_all_spans_against_a_loop(spark, sf):
    streams = {}
    for r in views.spans(spark, sf).orderBy("stream", "idx").collect():
        a = r.start % 100_000_000
        streams.setdefault(r.stream, []).append((a / 1000, (r.end - r.start + a) / 1000))
    assert max(map(len, streams.values())) > 20
    want = {}
    for stream, spans in streams.items():
        out = []
        for a, b in spans:
            if out and b - out[-1][0] <= 7200 + 1e-9:
                out[-1][1] = b
            else:
                out.append([a, b])
        want[stream] = (len(out), round(max(b - a for a, b in out), 3))
    assert {r.stream: (r.n, r.widest) for r in more.merge_fold(spark, sf).collect()} == want
