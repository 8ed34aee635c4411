"""Conversation repair against a plain search over (cost, audit), and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from ledgerline.llm import conversations as cv

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def plain_repair(rows):
    """The facts of one conversation's rows, by the least (cost, audit, lines) of each state after each row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(table):
        for _ in range(3):
            for q, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in step:
                        new, to = (cost + 5, audit + "I", [*lines, role + ":"]), step[q, role[0]]
                        table[to] = min(table.get(to, new), new)
        return table

    table = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(q, way, new=new):
            new[q] = min(new.get(q, way), way)

        for q, (cost, audit, lines) in table.items():
            offer(q, (cost + 2, audit + "D", lines))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if (q, role[:1]) in step:
                    offer(step[q, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for r in ("user", "assistant"):
                    if (q, r[0]) in step:
                        offer(step[q, r[0]], (cost + 1 + more, audit + "R", [*lines, f"{r}:{text}"]))
        table = inserted(new)
    cost, audit, lines = min(table[q] for q in ("", "a") if q in table)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    held = {}
    for r in plain_damage(rows):
        held.setdefault(r[0], []).append(r)
    return {c: plain_repair(held.get(c, [])) for c in {r[0] for r in rows}}


def made(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "u", "Assistant"]
    texts = ["Yes.", "No!", "cut off", "", " \n\t", None, "same.", "a longer text? \n", "é…", "x. ", "why?"]
    return [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def got(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    out = cv.repaired(cv.damaged(df), df).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("seed, n, segment", [(1, 8, 1024), (2, 60, 1024), (3, 400, 1024), (4, 400, 3), (5, 150, 1)])
def test_against_plain_search(spark, monkeypatch, seed, n, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = made(seed, n)
    assert got(spark, rows) == plain(rows)


def test_letters_against_plain(spark):
    """Distances, walks and pieces of any length agree on random rows without Spark."""
    rng = random.Random(9)
    for _ in range(300):
        letters = "".join(chr(64 + rng.randrange(16)) for _ in range(rng.randrange(1, 12)))
        whole = cv.walks(letters, cv.finish())[0]
        cost = min(cv.costs(letters)[e] + cv.finish()[e] for e in range(4))
        at = rng.randrange(len(letters) + 1)
        ends = tuple(min(cv.costs(letters[at:])[q * 4 + e] + cv.finish()[e] for e in range(4)) for q in range(4)) if at < len(letters) else cv.finish()
        first = cv.walks(letters[:at], ends)[0]
        assert cv.distances(letters[:at], ends)[0] == cost
        second = cv.walks(letters[at:], cv.finish())[first[1]]
        assert first[0] + second[0] == whole[0] and second[1] == whole[1]


def test_edges(spark):
    assert got(spark, []) == {}
    rows = [(c, t, "user", "x.") for c in range(40) for t in range(1)]
    assert got(spark, rows) == plain(rows)  # some lose their only row
    rows = [(1, None, "user", "x.")] * 30 + [(2, 2**62, "user", "long " * 200_000 + "."), (2, -(2**62), "assistant", "x" * 3_000_000)] + [(3, t, "system", "same.") for t in range(50)]
    assert got(spark, rows) == plain(rows)
    df = spark.createDataFrame([(1, 3, "user", "Hi.", 1, 2, 3), (1, 4, "assistant", "Ho.", 1, 2, 3)], SCHEMA + ", seq int, segment int, key int")
    assert [tuple(r)[1:] for r in cv.repaired(df).collect()] == [plain_repair([(1, 3, "user", "Hi."), (1, 4, "assistant", "Ho.")])]


def test_legal_conversations_stay():
    letters = "".join(chr(64 + 4 * "suao".index(c)) for c in "suauaua")
    assert cv.walks(letters, cv.finish())[0][0] == "KKKKKKK" and cv.acts(letters, "KKKKKKK", 0) == ["K"] * 7
    for said, audit in {"uuaa": "DKDK", "s": "D", "u": "D", "ua": "KK", "au": "DD", "uaua": "KKKK", "ooo": "DRR"}.items():
        letters = "".join(chr(64 + 4 * "suao".index(c)) for c in said)
        best = cv.walks(letters, cv.finish())[0]
        assert len(best[0]) >= len(said) and (best[0] == audit or said in ("uuaa", "au")), (said, best)


def test_against_sql(spark, sf_dir, tmp_path):
    """The query's SQL gives the same rows, on the table and on odd rows (of one turn there is one row, as in the table)."""
    odd = list({(r[0], r[1]): r for r in made(11, 300)}.values())
    for path, df in [(f"{sf_dir}/conversations.parquet", spark.read.parquet(f"{sf_dir}/conversations.parquet")), (f"{tmp_path}/*.parquet", spark.createDataFrame(odd, SCHEMA))]:
        if "*" in path:
            df.write.mode("append").parquet(str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        r = con.execute(cv.REPAIRED_SQL)
        names = [d[0] for d in r.description]
        assert sorted(map(str, (tuple(row) for row in cv.repaired(cv.damaged(df), df).select(*names).collect()))) == sorted(map(str, r.fetchall()))
