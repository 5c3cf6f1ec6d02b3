"""Conversation repair against edits tried one by one."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from cairn.llm import conversations as C

RNG = random.Random(9)


def cheapest(rows):
    """Cost and least letters over all edits, by trying each; rows are (initial, fault)."""
    on = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    put = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, put_in):
        found = []
        if put_in < 3:
            cost, letters, roles = best(i, put[state], put_in + 1)
            found.append((cost + 5, "I" + letters, (("new", put[state]), *roles)))
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
            return min(found) if found else (10**9, "", ())
        initial, fault = rows[i]
        cost, letters, roles = best(i + 1, state, 0)
        found.append((cost + 2, "D" + letters, roles))
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            if (state, initial) in on:
                cost, letters, roles = best(i + 1, on[state, initial], 0)
                found.append((cost + more, "K" + letters, (("row", i), *roles)))
            cost, letters, roles = best(i + 1, put[state], 0)
            found.append((cost + more + 1, "R" + letters, (("as", put[state], i), *roles)))
        return min(found, key=lambda x: x[:2])

    for i in range(len(rows), -1, -1):  # from the end on, so that no call goes deep
        for state in put:
            best(i, state, 0)
    return best(0, "", 0)


def plain(table):
    """Damage, faults and repair of (conv_id, turn, role, text) rows, a conversation at a time."""
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(" \t\n\r\x0b\x0c")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, letters, roles = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[r[1]]}:" if r[0] == "new" else f"{rows[r[1]][1]}:{rows[r[1]][2]}" if r[0] == "row" else f"{names[r[1]]}:{rows[r[2]][2]}" for r in roles]
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:], strict=False)]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def table(conversations=150, most=14):
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(RNG.randrange(most)):
            role = RNG.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "user "])
            text = RNG.choice(["Yes.", "no", "", None, " \t\n", "a b?", "Ünï!", "\xa0", f"text {turn}.", f"text {turn}"])
            for _ in range(RNG.choice([1, 1, 1, 1, 2, 3])):
                rows.append((conv, RNG.choice([turn, turn, turn + 3, None]), role, text))
    return rows


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_equals_trying_all_edits(spark, tmp_path, parts):
    rows = table()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, own string").repartition(3)
        df.write.parquet(f"{tmp_path}/conversations.parquet")
        found = key(map(tuple, C.op12_conversations(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == key(plain(rows))


def test_a_conversation_of_many_chunks(spark, tmp_path):
    """One conversation holds most rows, and goes over many tasks; repeated rows are far apart."""
    rows = [(1, t, RNG.choice(["user", "assistant"]), RNG.choice([f"row {t // 3}.", "again and again.", f"cut {t}"])) for t in range(1500)]
    rows += [(c, t, "user", "hi.") for c in (0, 2, 3) for t in range(4)] + [(9, None, "user", "x.")] * 50
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        df = spark.read.parquet(f"{tmp_path}/conversations.parquet")
        assert C.chunks(C.damaged(df)).filter("own = 1").count() > 10
        found = key(map(tuple, C.op12_conversations(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == 5
    assert found == key(plain(rows))


def test_checkpoints_give_what_all_costs_give():
    for _ in range(300):
        rows = tuple((RNG.choice("suaux"), RNG.choice([0, 0, 0, 1, 2, 3]), RNG.choice([1, 1, 1, 2, 5])) for _ in range(RNG.randrange(12)))
        each = tuple(x for i, f, n in rows for x in [(i, ["", "truncated", "blank", "duplicate"][f])] + [(i, "blank" if f == 2 else "duplicate")] * (n - 1))
        cost, letters, _ = cheapest(each)
        walked = list(C.walk(list(rows), C.END, C.START, True))
        assert C.costs(list(rows), C.END)[C.START] == cost and "".join(w[0] * w[3] for w in walked) == letters


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op12_conversations(spark, str(tmp_path)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "hi.")], empty.schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in C.op12_conversations(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(empty.withColumn("copies", F.lit(1))).count() == 0
