"""Secret scans and archives."""

import hashlib
import io
import random
import re

import numpy as np
import pytest
from llm_fixtures import SMALL, make_docs  # noqa: F401

from caselink.llm import secret_scan, warc

ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


ODD = [
    "",
    "token=abc token=abcdef API_KEY: 'x/y+z=1' apikey=\"q.q_q-q1",
    "PassWd\"  :   'hunter2hunter2' secret=secret=abcdef",
    "token=token:abcdefgh",
    "ſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIAAKIA" + "0" * 12,
    "é😀 " + "0123456789abcdef" * 2 + "g" + "a" * 23 + " " + "b" * 24,
    "password=0123456789abcdef0123456789abcdef",
    "x\npassword\n= abcdefgh\npassword = \nabcdefgh",
]


@pytest.fixture(scope="module")
def network(spark):
    return secret_scan.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_rules_are_exact():
    r = random.Random(2)
    parts = ["token", "=", ":", " ", '"', "'", "AKIA", "abcdef12", "0" * 9, "A" * 7, "\n", "é", "secret", "api_key", "passWord", "deadbeef", "."]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(800)]
    got = [[] for _ in texts]
    for text, begin, end, kind in secret_scan.scan(texts).spans:
        got[text].append((begin, kind, end))
    assert [sorted(g) for g in got] == [brute_spans(t) for t in texts]


def test_candidates_are_runs_no_rule_touches():
    text = "a1" * 8 + " " + "b" * 30 + " " + "7" * 30 + " token=" + "Zz9" * 8 + " short1 " + "q9-" * 10
    got = secret_scan.scan(["x", text]).candidates
    assert [(t, text[a:b]) for t, a, b in got] == [(1, "a1" * 8), (1, "q9-" * 10)]


def test_candidates_of_any_length_after_a_sign():
    text = "pin: 4821, pass = \"Ab1\" x=yz a: \n b q" + "w" * 20 + " 12:30 = " + "8" * 20 + "!"
    got = secret_scan.scan(["k:", text, "v"]).candidates
    assert [(t, text[a:b]) for t, a, b in got] == [(1, x) for x in ("4821", "Ab1", "x=yz", "q" + "w" * 20, "30", "8" * 20)]


def test_runs_like_keys_teach_nothing(spark, make_docs):  # noqa: F811
    docs = make_docs((1, "bare qW3rT5yU7iO9pA1sD2fG4hJ6 here"), (2, "some-ordinary-words-2024 here"), (3, "token=abc123def456"))
    findings, labels = secret_scan.labelled_findings(docs)
    assert sorted((f.run, x) for f, x in zip(findings, labels)) == [("abc123def456", 1), ("some-ordinary-words-2024", 0)]


def test_thresholds_count_every_finding_held_back():
    """One count stands for many findings: a threshold must move with them."""
    counts = secret_scan.Counter({("assigned", "corpus", 1, 512): 30, ("assigned", "corpus", 0, -512): 500, ("assigned", "plain", 1, 1024): 60})
    few, many = secret_scan.Network(), secret_scan.Network()
    few.calibrate(counts, 0.95)
    many.calibrate(counts + secret_scan.Counter({("assigned", "corpus", 1, 128): 100_000}), 0.95)
    logit = lambda net: (np.log(net.thresholds["assigned"] / (1 - net.thresholds["assigned"])) - net.shift) / net.slope
    assert logit(few) == pytest.approx(512 / secret_scan.SLOTS) and logit(many) == pytest.approx(128 / secret_scan.SLOTS)
    assert few.thresholds["bare"] == 0.5


def test_all_documents_teach_in_parts(spark, make_docs, monkeypatch):  # noqa: F811
    """Every finding of every document is trained on or held back, once; parts are averaged into a network that works."""
    monkeypatch.setattr(secret_scan, "PART_FINDINGS", 40)
    monkeypatch.setattr(secret_scan, "CONTEXTS", 5)
    seen = []
    real, held = secret_scan._mean_of_parts, secret_scan._counted_corpus
    monkeypatch.setattr(secret_scan, "ROUNDS", 3)
    monkeypatch.setattr(secret_scan, "_mean_of_parts", lambda dealt, *rest: seen.append({(r["run"], r["part"]) for r in dealt.filter("label is not null").collect()}) or real(dealt, *rest))
    monkeypatch.setattr(secret_scan, "_counted_corpus", lambda rows, net: seen.append({r["run"] for r in rows.collect()}) or held(rows, net))
    docs = make_docs(*[(i, f"see token=abc{i}def456 and some-ordinary-words-{i} here") for i in range(60)])
    net = secret_scan.train(docs, generated=300)
    runs = {f"abc{i}def456" for i in range(60)} | {f"some-ordinary-words-{i}" for i in range(60)}
    assert len({part for _, part in seen[0]}) > 1 and seen[0] == seen[1] == seen[2]
    assert {run for run, _ in seen[0]} | seen[3] == runs and not {run for run, _ in seen[0]} & seen[3]
    findings, labels = secret_scan.labelled_findings(docs)
    scores = net.scores(findings)
    assert scores[np.array(labels) == 1].min() > scores[np.array(labels) == 0].max()


def test_network_finds_held_out_secrets(network):
    findings, labels, shapes = secret_scan.generated_findings([], 3000, seed=99)
    found, labels, shapes = network.secret(findings), np.array(labels), np.array(shapes)
    for shape in np.unique(shapes[labels == 1]):
        assert found[(labels == 1) & (shapes == shape)].mean() >= 0.85, shape
    assert found[labels == 1].mean() >= 0.9
    assert found[labels == 0].mean() <= 0.02


def test_gradients_match_differences():
    findings, labels, _ = secret_scan.generated_findings([], 12, seed=1)
    labels, net = np.array(labels, float), secret_scan.Network()

    def loss():
        logit = net.logits(findings)
        return np.mean(np.logaddexp(0, logit) - labels * logit)

    grads = net._gradients(findings, labels)
    for name, grad in zip(("filters", "bias", "dense", "dense_bias", "out", "out_bias"), grads):
        weights = getattr(net, name)
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = weights[at], 1e-5
        weights[at] = kept + step
        high = loss()
        weights[at] = kept - step
        low = loss()
        weights[at] = kept
        assert abs((high - low) / (2 * step) - grad[at]) < 1e-4 + 0.02 * abs(grad[at])


def test_query_rows(spark, network):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = secret_scan.find_secrets(docs, network).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = brute_spans(texts[row["doc_id"]])
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        every = [s for s in row["spans"].split(",") if s]
        assert [s for s in every if not s.startswith("model")] == [s for s in listed.split(",") if s]
        assert len(every) == len(base) + row["n_model"]


def test_redacted_text(spark, make_docs, network):  # noqa: F811
    key = "ghp_" + "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vW1xY3"
    docs = make_docs((1, f"use {key} now"), (2, "password=abcdef12 deadbeef"), (3, "clean text, mail5.example.com"), (4, None), (4, ""), (5, "0" * 200_000), extra=True)
    out = secret_scan.redact(docs, network)
    assert out.schema == docs.schema
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert texts == [(1, "use [SECRET] now"), (2, "[SECRET] deadbeef"), (3, "clean text, mail5.example.com"), (4, None), (4, ""), (5, "[SECRET]")]


def test_edge_rows_of_scans(spark, make_docs, network):  # noqa: F811
    docs = make_docs((None, None), (1, ""), (1, ""), extra=True)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[1:] for r in secret_scan.find_secrets(docs, network).collect()] == [(0, 0, 0, empty, "", 0)] * 3
    assert secret_scan.find_secrets(docs.limit(0), network).collect() == []
    # No rows to learn from: the generated findings train alone.
    assert secret_scan.secret_spans(docs.limit(0)).collect() == []


PAGES = "page_id long, url string, html string"


def archived(spark, rows):
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS payload", "'x' AS digest", "2 AS refers_to")
    return sorted((tuple(r) for r in warc.archive_digests(frame).collect()), key=str)


def brute_archive(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        other = len(payload) >= 100 and first.get(html or "", page) != page
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if other else "response", first[html] if other else None))
    return sorted(out, key=str)


def test_archive_of_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert archived(spark, rows) == brute_archive(rows)


def test_odd_pages(spark):
    page = "<p>é😀</p>\r\n\r\n" * 20
    rows = [
        (5, "u", page), (3, "http://x/é y", page), (9, None, page), (None, None, page), (None, "n", "z" * 500),
        (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 100_000),
        (8, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "w" * 99), (11, "u", "w" * 99),
    ]
    assert archived(spark, rows) == brute_archive(rows)
    assert warc.archive_digests(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("records", [1, 5, 3000])
def test_frames_stand_alone(records):
    class Kept(io.BytesIO):
        def close(self):
            pass

    r, stream = random.Random(1), Kept()
    bodies = [(" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(300)))).encode() for _ in range(records)]
    writer = warc.ArchiveWriter(stream)
    for i, body in enumerate(bodies):
        writer.add(warc._record(i, "u", body, hashlib.sha256(body).hexdigest(), None))
    writer.close()
    stream.seek(0)
    assert stream.read(4) == b"\x5d\x2a\x4d\x18"
    stream.seek(0)
    got = [block.partition(b"\r\n\r\n")[2] for _, block in warc.read_records(stream)]
    assert got == bodies
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(stream.getvalue()[:-3])))
