import hashlib
import random
import re
import time

from claimlens.llm import secret_scan

from .rows import SCHEMA, awkward, empty_frame, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ORDER = {k: n for n, k in enumerate(("assign", "access", "hex"))}


def by_hand(text):
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return [f"{k}:{a}:{b}" for k, a, b in spans]


HEX = hashlib.sha256(b"1").hexdigest()
TEXTS = [
    f'token = "{HEX[:40]}" and more', f"é\U0001f600 secret:{HEX[:5]} token=token :abcdefg", "PassWd='aB3+/xyz_9' api_key=abc api_KEY = longenough", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + " AKIA",
    f"{HEX}{HEX} x{HEX[:23]}", "password == 'abc", "token=secret=abcdef", HEX[:24] + "g" + HEX[:30], " ".join(f"token={HEX[:8]}{k}" for k in range(300)),
]


def test_base_spans(spark):
    rows = awkward() + [(200 + k, t, None, None, None, None, None, None, None) for k, t in enumerate(TEXTS)]
    got = secret_scan.digest(secret_scan.scan(spark.createDataFrame(rows, SCHEMA), n_random=400, n_docs=20)).collect()
    want = {(d, ",".join(by_hand(t))) for d, t, *_ in rows}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.base_sha256) for r in got} == {(d, hashlib.sha256(s.encode()).hexdigest()) for d, s in want}
    for r in got:
        if r.doc_id and r.doc_id >= 200:
            base = by_hand(TEXTS[r.doc_id - 200])
            assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == base
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ORDER)


def test_model_finds_random_strings_and_leaves_identifiers(spark):
    rnd = ["Zk3vQ9xB7nR2mT5wY8pL4cF6", "q7Jx0pWm3vZt9Rk2Lh5Ys8Bd1Nf4", "mGqZ/8s+Tfw2XcVbn3JkLp0Q="]
    plain = ["customer_address_line_number", "getElementsByClassNameFromParent", "internationalisation-of-documents", "src/main/resources/templates"]
    rows = [(k, prose(k, 300)) for k in range(40)] + [(100 + k, f"value {s} here") for k, s in enumerate(rnd + plain)]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), n_random=4000)).collect()}
    assert all(got[100 + k].spans == f"random:6:{6 + len(s)}" for k, s in enumerate(rnd))
    assert all(not got[d].n_random for d in range(40))
    assert sum(got[103 + k].n_random for k in range(len(plain))) == 0


def test_redact_and_empty(spark):
    rows = [(1, TEXTS[0], 9), (2, "nothing", 7), (3, None, None)]
    out = {r.doc_id: r for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[1].text == '[SECRET]" and more' and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[2].n_chars, out[3].text) == ("nothing", 7, None)
    assert secret_scan.scan(empty_frame(spark)).count() == 0


def test_redact_many_spans_in_a_long_text(spark):
    """Merged spans are cut out one by one here; adjacent ones stay apart, overlapping ones become one mark."""
    rows = [(k, t, None) for k, t in enumerate([*TEXTS, " ".join(f"é{prose(k, 2)} token={HEX[:20]}{k}\n" for k in range(1500)), HEX * 40 + " \U0001f600", "AKIA" + "B" * 2000 + " token=" + "c" * 1100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spans = {r.row.doc_id: [(x.start, x.end) for x in r.found] for r in secret_scan.scan(docs).collect()}
    for r in secret_scan.redact(docs).collect():
        text, want, at = rows[r.doc_id][1], "", 0
        merged = []
        for a, b in spans[r.doc_id]:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            want, at = want + text[at:a] + "[SECRET]", b
        assert r.text == want + text[at:]


def test_a_long_candidate_takes_time_in_proportion(spark):
    rng = random.Random(4)
    blob = "".join(rng.choices(secret_scan.ALPHABET, k=1_000_000))
    took = []
    for n in (250_000, 250_000, 1_000_000):
        docs = spark.createDataFrame([(1, f"see {blob[:n]} there")], "doc_id long, text string")
        begin = time.time()
        found = secret_scan.digest(secret_scan.scan(docs)).first()
        took.append(time.time() - begin)
        assert found.spans.endswith(f"random:4:{n + 4}")
    assert took[2] < 6 * took[1] + 5
