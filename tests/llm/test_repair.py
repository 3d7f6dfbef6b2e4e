import functools
import hashlib
import random
import re
import zlib

import duckdb

from maskwright.llm import queries as Q
from maskwright.llm import repair as R

FITS = {"": "u", "s": "u", "a": "u", "u": "a"}


def cheapest(rows):
    """(cost, audit, repaired turns) of rows (role, text, fault), by trying all edits from every place and state."""

    @functools.lru_cache(None)
    def best(i, state, puts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        fit = FITS[state]
        name = {"u": "user", "a": "assistant"}[fit]
        if puts < 4:
            c, e, t = best(i, fit, puts + 1)
            found.append((c + 3, "I" + e, ((name, ""), *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] == fit or (role[:1] == "s" and state == ""):
                    c, e, t = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + e, ((role, text), *t)))
                c, e, t = best(i + 1, fit, 0)
                found.append((c + 3 + more, "R" + e, ((name, text), *t)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # keeps the recursion shallow
        for state in FITS:
            best(i, state, 0)
    return best(0, "", 0)


def brute(rows):
    """The contract as loops: rows (conv_id, turn, role, text) to audits by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text, mine = role if role is not None else " ", text if text is not None else " ", convs.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, repaired = cheapest(tuple(judged))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, digest)
    return out


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", *R._DIGEST).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, copies string").drop("copies")


def test_random_conversations(spark):
    draw = random.Random(5)
    texts = ["Hi there.", "What?", "no end", "", " \t", "Yes!", None, "a:b\nc.", "Ok. "]
    rows = [(conv, turn, draw.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), draw.choice(texts)) for conv in range(120) for turn in range(draw.randint(1, 9)) if draw.random() < 0.9]
    rows += [(None, t, "user", "Null.") for t in (None, 3, None)] + rows[:15] + [(7, None, "assistant", "x" * 300_000)]
    assert got(R.damage_audit(frame(spark, rows))) == brute(rows)


def test_one_conversation_over_all_partitions(spark):
    draw = random.Random(6)
    rows = [(1, t, draw.choice(["user", "assistant", "system"]), draw.choice(["Same.", f"Own {t}.", f"cut {t}"])) for t in range(600)] + [(2, 0, "user", "One."), (0, 0, "assistant", "Two.")]
    rows += [(3, 5, "user", "Often.")] * 400
    df = frame(spark, rows)
    parts = R.repair(R.damaged(df)).filter("conv_id = 1").select("part").distinct().count()
    assert parts > 1
    want = brute(rows)
    assert got(R.damage_audit(df)) == want


def test_repaired_turns_are_well_formed(spark, sf):
    edits = R.repair(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    convs = {}
    for r in sorted((r for r in edits if r.edit != "D"), key=lambda r: (r.part, r.place)):
        convs[r.conv_id] = convs.get(r.conv_id, "") + r.role[0]
    assert convs and all(re.fullmatch("(s?(ua)+)?", c) for c in convs.values())


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = R.damage_audit(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert R.damage_audit(frame(spark, [])).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute("SELECT conv_id, " + ", ".join(R._DIGEST) + f" FROM ({Q.REPAIR_SQL})").fetchall()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(Q.op11_structure_repair(spark, sf)) == want == brute(rows)
