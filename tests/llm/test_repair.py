"""Conversation repair against brute force over all edits."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from milemark.llm import repair as R

NEXT, STATE = {0: "su", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}


def brute(rows):
    """(cost, edits) over all edits with up to four turns put in at a place."""

    @functools.cache
    def best(i, s, put_in):
        ways = []
        if i == len(rows):
            ways += [(0, "")] if s in (0, 3) else []
        else:
            initial, fault = rows[i]

            def then(edit, cost, state):
                c, said = best(i + 1, state, 0)
                ways.append((c + cost, edit + said))

            then("D", 2, s)
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                if initial and initial in NEXT[s]:
                    then("K", more, STATE[initial])
                then("R", 1 + more, STATE[NEXT[s][-1]])
        if put_in < 4:
            c, said = best(i, STATE[NEXT[s][-1]], put_in + 1)
            ways.append((c + 5, "I" + said))
        return min(ways) if ways else (10**9, "~")

    return best(0, 0, 0)


def test_cheapest_edits():
    rng = random.Random(5)
    for k in range(4000):
        roles = ("sua", ["u", "a", "", "s"], ["", "", "", "u"])[k % 3]
        faults = ["", "", "", "t", "d", "b"] if k % 3 else ["", "t", ""]
        rows = tuple((rng.choice(roles), rng.choice(faults)) for _ in range(rng.randint(0, 12)))
        assert R.audit(list(rows)) == brute(rows)


def test_edits_are_settled_early():
    """Memory follows what is open: of a regular conversation only the last rows, of a truly ambiguous one all."""
    regular = R.Repair(R.START)
    for k in range(5000):
        regular.add("ua"[k % 2], "td"[k % 7 == 0] if k % 5 == 0 else "")
    assert len(regular.out) > 4900
    open_ = R.Repair(R.START)
    for _ in range(501):
        open_.add("", "")
    assert not open_.out
    cost, state, more = R.settle(open_)
    assert (cost, "".join(open_.rest(state)) + more) == (502, "D" + "R" * 500)


def damage(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        said = lambda v: " " if v is None else str(v)
        how = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text, own = said(role), said(text), by[conv]
        if how != 0:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return by


def expected(turns):
    out = {}
    for conv, rows in damage(turns).items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = R.audit(list(zip(initials, faults, strict=True)))
        days = {r[0] for r in rows if r[0] is not None}
        state, said, left = 0, [], iter(rows)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else NEXT[state][-1]
            said.append((role if edit == "K" else {"u": "user", "a": "assistant"}[initial]) + ":" + text)
            state = STATE[initial]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(days) - min(days) + 1 - len(days) if days else 0
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), said)
    return out


def reported(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(R.op13(spark, sf)) == {k: v[:-1] for k, v in expected(turns).items()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd():
    """A conversation with most of the rows, nulls everywhere, ties, other roles, rows alike, very long text."""
    rng = random.Random(2)
    roles = ["user", "assistant", "system", None, "tool", "user: x", ""]
    texts = [None, "", "ok.", "a, b", "hm?", " \n", "é" * 9 + ".", "y\r\n"]
    rows = [
        (rng.choice([None, 7, 7, 7, 7, 8]), rng.choice([None, *range(-3, 600)]), rng.choice(roles), rng.choice([*texts, f"x{k}", f"z{k}."])) for k in range(2500)
    ]
    return rows + [(9, 3, "user", "same.")] * 400 + [(10, None, None, None)] * 3 + [((1 << 53) + 1, 1, "user", "w " * 50_000)]


@pytest.mark.parametrize("ranges", [3, 25])
def test_odd_rows(spark, odd, ranges):
    """A long conversation that lies in many ranges of the order, each repaired for itself."""
    want = expected(odd)
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(777) for c in ("k", "th", "at", "n", "fault", "part", "x.y")}).repartition(5)
    df = R.damaged(df)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert reported(R.report(df, spark.createDataFrame(odd, SCHEMA))) == {k: v[:-1] for k, v in want.items()}
        said = defaultdict(list)
        for r in sorted(R.repaired(df).collect(), key=lambda r: (r["at"], r["nth"])):
            said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert said == {k: v[-1] for k, v in want.items() if v[-1]}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_small_pieces(spark, odd, monkeypatch):
    """Edits that go out in many pieces join to the same audit."""
    done = []
    chunk = R._Chunk("7", 0, 0, (R.START,))
    monkeypatch.setattr(R, "PIECE", 3)
    rows = [("ua"[k % 2], "" if k % 9 else "t", 1 + (k % 4 == 0)) for k in range(300)]
    for row in rows:
        done += chunk.add(*row)
    done += chunk.close()
    settled = [r for r in done if r[2] == R.START and r[3] is None and r[6]]
    assert len(settled) > 20 and [r[5] for r in settled] == sorted(r[5] for r in settled)
    plain = [x for initial, fault, n in rows for x in [(initial, fault)] + [(initial, "d")] * (n - 1)]
    ends = {r[3]: (r[7], r[6] or "") for r in done if r[3] is not None}
    cost, state = min((c + 5 * len(R.ending(b)), b) for b, (c, _) in ends.items())
    audit = "".join(r[6] for r in settled).replace(",", "") + ends[state][1].replace(",", "") + R.ending(state)
    assert (cost, audit) == R.audit(plain)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.report(R.damaged(none), none).count() == 0
    assert R.repaired(none).count() == 0
