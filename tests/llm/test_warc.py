import hashlib
import random

from tidepool.llm.common import cut
from tidepool.llm.warc import LoserTree, archive, merge_index, plan_records, read_archives, write_archives


def pages(spark, n=60):
    rng = random.Random(1)
    body = ["<p>é" + "x" * 120 + "</p>", "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\n\r\n\r\n" + "y" * 100, "short", None, "z\n" * 40_000]
    rows = [(i, rng.choice(["https://www.Ex.org/a?b=1#c", "http://ex.org/b", "not a url", None, "https://u:p@h.example.com:80/x y"]), rng.choice(body)) for i in range(n)]
    rows += [(0, rows[0][1], rows[0][2]), (None, "http://ex.org/b", body[0]), (900, "u", "q" * 99), (901, "u", "q" * 99), (902, "u", "q" * 100), (903, "u", "q" * 100)]
    return rows, spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, url_key string, payload string")


def want(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in raw:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in raw:
        f = first.get(b) if len(b) >= 100 else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if f is not None and f != i else "response", f if f != i else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = archive(df.repartition(5)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted([tuple(r) for r in got], key=str) == want(rows)
    assert archive(df.limit(0)).count() == 0


def test_payloads_come_back_and_files_are_sorted_runs(spark, tmpdir_path):
    rows, df = pages(spark)
    path = tmpdir_path + "/warc"
    write_archives(plan_records(df).repartition(4), path)
    found = read_archives(spark, path, with_payload=True).collect()
    texts = {(r.page_id, bytes(r.payload).decode()) for r in found if r.record_type == "response"}
    assert texts <= {(i, h or "") for i, _, h in rows} and len({t for _, t in texts}) == len({h or "" for _, _, h in rows})
    assert all(r.payload == b"" for r in found if r.record_type == "revisit")
    by_run = {}
    for r in sorted(found, key=lambda r: r.seq):
        by_run.setdefault(r.run, []).append((bytes(r.url_key), r.capture_time))
    assert len(by_run) > 1 and all(v == sorted(v) for v in by_run.values())


def test_histories_are_in_global_order(spark):
    _, df = pages(spark, 200)
    from tidepool.session import scratch_path

    path = scratch_path(spark, f"warc-test-{random.random()}")
    write_archives(plan_records(df).repartition(7), path)
    merged = merge_index(cut(read_archives(spark, path), "t"))
    order = [(bytes(r.url_key), r.capture_time, r.page_id is not None, r.page_id or 0) for r in merged.collect()]
    assert order == sorted(order) and len(order) == df.count()


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)
