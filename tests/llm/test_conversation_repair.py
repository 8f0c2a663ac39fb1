import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

from claimlens.llm import conversation_repair as repair

from .rows import prose

SHAPE = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Edits of rows (role, text, fault): every sequence of edits by cost and letters, until one gives a legal conversation."""
    limit = len(rows) + 6
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in out)
        if i == len(rows) and SHAPE.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if len(out) < limit:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, (*out, (new, text))))


def by_hand(table):
    said = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
            rows += [(turn, "user" if kind == 4 else said(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty, count = set(), [], Counter()
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            faulty.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, fixed = cheapest(faulty)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(fixed.encode()).hexdigest())
    return out


def table(seed, n):
    rng, out = random.Random(seed), []
    texts = ["Hello there.", "What now?", "no end", "", " \t", "Good!", "Well, yes. ", None, "été\x0b", "one\ntwo."]
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    return out


SCHEMA = "conv_id long, turn int, role string, text string"


def test_against_search(spark):
    rows = table(1, 250) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, None, None)]
    got = {r[0]: tuple(r[1:]) for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_hand(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())


def test_every_short_signature():
    faults = {"x": ("user", "blank"), **{c: (r, "") for c, r in zip("suao", ("system", "user", "assistant", "tool"), strict=True)}, **{c: (r, "truncated") for c, r in zip("SUAO", ("system", "user", "assistant", "tool"), strict=True)}}
    for n in range(4):
        for sig in itertools.product(faults, repeat=n):
            assert repair.solve("".join(sig)) == cheapest([(faults[c][0], "t", faults[c][1]) for c in sig])[:2], sig


def test_long_conversation_and_long_text(spark):
    sig = "sua" + "Uaxuuo" * 20_000
    cost, audit = repair.solve(sig)
    assert len(audit.replace("I", "")) == len(sig) and cost > 0
    rows = [(5, k, ("user", "assistant")[k % 2], f"{prose(k % 7, 3)} {k}.") for k in range(4000)] + [(6, 0, "user", "x" * 500_000 + "."), (6, 1, "assistant", "y.")]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {5, 6} and got[5].gaps > 0 and len(got[5].audit) > 3000


def test_repeated_rows_empty_table_and_clashing_names(spark):
    rows = [(1, 0, "user", "Same.")] * 3 + [(1, 1, "assistant", "Other.")] * 2
    got = {r[0]: tuple(r[1:]) for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_hand(rows) and got[1][2] >= 2
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    taken = "kind copy digest sig n cost audit is_head own_id at before seen fault code initial ended gaps".split()
    crowded = spark.createDataFrame([(*r, *map(str, range(len(taken)))) for r in rows], SCHEMA + "".join(f", {c} string" for c in taken))
    assert {r[0]: tuple(r[1:]) for r in repair.repair(crowded).collect()} == got
