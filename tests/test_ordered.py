"""Streams of deltas in disorder, with repeats, errors, cancels and requests that never end."""

import random
import time

from sparkloom.streaming import deltas, ordered


def feed(spark, folder, batches, ttl_s=600, pause=0.0):
    """Rows of all batches through the stream, one after another, over one checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ordered.DELTAS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k + 1 < len(batches) and pause:
            run(spark, folder, ttl_s)
            time.sleep(pause)
    return run(spark, folder, ttl_s)


def run(spark, folder, ttl_s):
    out = deltas.run_available(spark, f"{folder}/in", ordered.DELTAS, lambda s: ordered.ordered_lines(s, ttl_s), f"{folder}/out", timers=True)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.requestId, r.n)):
        got.setdefault(r.requestId, []).append((r.n, r.kind, r.text))
    return got


def row(request, seq, delta="", done=False, error=None, cancelled=False):
    return request, seq, delta, done, error, cancelled


def test_disorder_repeats_errors_and_cancels(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c\n", "\n", "d e", "\nf"]) for _ in range(60))
    parts = [text[k : k + 3] for k in range(0, len(text), 3)]
    rows = [row("r", k, p, k == len(parts) - 1) for k, p in enumerate(parts)]
    rng.shuffle(rows)
    batches = [rows[k::4] for k in range(4)]
    batches[1] = batches[1] + [r for r in batches[0] if not r[3]][:5]
    batches[0] += [row("bad", 0, "one\ntw"), row("gone", 1, "late"), row("null", 0, None), row("null", 1, None, True)]
    batches[2] += [row("bad", None, None, error="broken"), row("gone", 0, "x\ny"), row("gone", None, cancelled=True)]
    got = feed(spark, tmp_path, batches)
    lines = [x for x in text.split("\n") if x]
    assert got["r"] == [(k + 1, "line", x) for k, x in enumerate(lines)] + [(len(lines) + 1, "done", "")]
    assert got["bad"] == [(1, "line", "one"), (2, "line", "tw"), (3, "error", "broken")]
    assert got["gone"] == [(1, "line", "x"), (2, "line", "ylate"), (3, "cancelled", "")]
    assert got["null"] == [(1, "done", "")]


def test_a_silent_request_expires(spark, tmp_path):
    batches = [[row("dead", 0, "begun"), row("dead", 2, "early"), row("live", 0, "a\n")], [row("live", 1, "b", True)], [row("other", 0, "c", True)]]
    got = feed(spark, tmp_path, batches, ttl_s=1, pause=2.5)
    assert got["dead"] == [(1, "line", "begun"), (2, "expired", "waited for 1")]
    assert [x[1:] for x in got["live"]][0] == ("line", "a") and ("other", [(1, "line", "c"), (2, "done", "")]) in got.items()
