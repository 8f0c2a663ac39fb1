"""Repair of the role structure of conversations by signature deduplication.

Each row after damage is one character: its role's initial (s, u, a, else o), a capital if the text is truncated, x if the row
has to go (blank or duplicate). The characters of a conversation in order are its signature. Signatures repeat, so each
different one is solved once, by a memoised recursion over (row, state) whose letters give the audit; audits are joined back to conversations, and
their edits are replayed over the rows as a stream, so that a text is held one at a time.

A conversation is one sequence: its rows are sorted together (spilling if need be), its signature is a character a row, and the digest of
its repaired text is computed in one go, as the contract's hash asks for. Signatures of very many conversations are joined by salts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, drop_stored, short, stored, with_counted

#: What edits cost, and the initials that may follow each other.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ["su", "ua", "au"]
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
#: After nothing, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Inserts in front of one row that can pay: a user turn and an answer.
INSERTS = 2


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: the rows that are left after damage; null parts count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _ordered(rows: DataFrame) -> DataFrame:
    """With the digest of the text, which orders rows of one turn and role."""
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


ORDER = [F.asc_nulls_first, F.asc, F.asc, F.asc]
BY = ["turn", "role", "digest", "copy"]


def _order() -> list:
    return [f(c) for f, c in zip(ORDER, BY, strict=True)]


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, STATS, sig of ordered rows; one shuffle by conversation."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = rows.select("conv_id", *BY, F.substring("role", 1, 1).alias("initial"), (bare == "").alias("is_blank"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"))
    w = Window.partitionBy("conv_id").orderBy(*_order())
    x = slim.select("*", F.row_number().over(w).alias("at"), F.lag("initial").over(w).alias("before"), F.lag("turn").over(w).alias("turn_before"))
    x = x.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("at")) > 1)
    fault = F.when(F.col("is_blank"), "blank").when(F.col("seen"), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    x = x.withColumn("fault", fault).withColumn("code", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role))
    new_turn = F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False))
    return x.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if(new_turn), F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in STATS[1:4]),
        F.count_if((F.col("at") > 1) & ~F.concat("before", "initial").isin(*LEGAL)).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda c: c["code"]), "").alias("sig"),
    )


def _after(state: int) -> int:
    """The state after the turn that a user or assistant makes next."""
    return ASSISTANT if state == USER else USER


def solve(sig: str) -> tuple[int, str]:
    """The least cost of a signature, and the ASCII-least audit that has it.

    No two edits of one row from one state share a letter, so of equal costs the least letter decides. Costs are kept in an
    array for each (state, inserts left); the recursion is started from the last row backwards, so it is never deep.
    """
    n = len(sig)
    memo = {(s, left): array("q", [-1]) * (n + 1) for s in range(4) for left in range(INSERTS + 1)}

    def edits(i: int, state: int, left: int) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        """Letter, cost and what is left to solve, by letter."""
        if i < n:
            yield "D", DELETE, (i + 1, state, INSERTS)
        if left:
            yield "I", INSERT, (i, _after(state), left - 1)
        if i < n and (code := sig[i]) != "x":
            own, extra = code.lower(), TRUNCATED * code.isupper()
            if own == "s" and state == START:
                yield "K", extra, (i + 1, SYSTEM, INSERTS)
            elif own == ("a" if state == USER else "u"):
                yield "K", extra, (i + 1, _after(state), INSERTS)
            yield "R", REROLE + extra, (i + 1, _after(state), INSERTS)

    def cost(i: int, state: int, left: int) -> int:
        known = memo[state, left]
        if known[i] < 0:
            done = i == n and state in (START, ASSISTANT)
            known[i] = 0 if done else min((c + cost(*then) for _, c, then in edits(i, state, left)), default=1 << 40)
        return known[i]

    for i in range(n, -1, -1):
        for state in range(4):
            cost(i, state, INSERTS)
    at, audit = (0, START, INSERTS), []
    while cost(*at) or at[0] < n:
        letter, at = next((letter, then) for letter, c, then in edits(*at) if c + cost(*then) == cost(*at))
        audit.append(letter)
    return cost(0, START, INSERTS), "".join(audit)


def solved(sigs: DataFrame) -> DataFrame:
    """sig, n, cost, audit of rows sig, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            got = [solve(s) for s in b["sig"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"sig": b["sig"], "n": b["n"], "cost": pa.array([c for c, _ in got], pa.int64()), "audit": pa.array([a for _, a in got], pa.string())})

    return sigs.mapInArrow(run, "sig string, n long, cost long, audit string")


class _Replay:
    """Applies an audit to the rows of a conversation, one after another."""

    def __init__(self, audit: str):
        self.letters, self.state, self.sha, self.any = iter(audit), START, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def turn(self, text: str) -> None:
        self.line("assistant" if self.state == USER else "user", text)
        self.state = _after(self.state)

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self.turn("")
                continue
            if letter == "R":
                self.turn(text)
            elif letter == "K":
                self.line(role, text)
                self.state = SYSTEM if role[:1] == "s" else _after(self.state)
            return

    def digest(self) -> str:
        for _ in self.letters:
            self.turn("")
        return self.sha.hexdigest()


def replayed(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """heads with repaired_sha256: the edits of their audits applied to ordered rows."""
    kind = heads.schema["conv_id"].dataType.simpleString()
    told = [*STATS, "cost"]
    both = heads.select("conv_id", *told, "audit", F.lit(True).alias("is_head")).unionByName(rows.select("conv_id", *BY, "text"), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("is_head"), *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        out: list[tuple] = []
        for b in short(batches):
            for r in zip(*(b[c].to_pylist() for c in ("is_head", "conv_id", *told, "audit", "role", "text")), strict=True):
                if r[0]:
                    out += [(*head, now.digest())] if now else []
                    head, now = r[1:-2], _Replay(r[-3])
                else:
                    now.row(r[-2], r[-1])
            if len(out) > 1000:
                yield made(out)
                out = []
        if now:
            yield made([*out, (*head, now.digest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    names = ["conv_id", *told, "audit", "repaired_sha256"]
    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in told)}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id of the table.

    A null conv_id is a conversation like others. Null turns come first and count for no gap; a null role or text is one space, so such a
    text is blank. Rows of one turn are taken by role, then by the digest of their text; equal rows are neighbours, the first
    may stay. A conversation of which damage leaves nothing has zeros, an empty audit and the digest of an empty text. Long texts
    and long conversations are streamed. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _ordered(damaged(conversations))
    sigs = stored(signatures(rows))
    answers = stored(solved(sigs.groupBy("sig").agg(F.count("*").alias("n"))))
    found = with_counted(sigs, answers, ["sig"]).drop("sig", "n")
    ids = conversations.select("conv_id").distinct()
    own = found.withColumnRenamed("conv_id", "own_id")
    heads = ids.join(own, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id").na.fill(0, [*STATS, "cost"]).na.fill("", ["audit"])
    heads = stored(heads)
    drop_stored(sigs, answers)
    return replayed(heads, rows)
