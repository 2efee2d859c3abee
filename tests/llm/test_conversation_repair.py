"""Repairs against a plain search over all edits, chunks against whole conversations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow.parquet as pq
import pytest
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from areashift.llm import conversation_repair as repair
from areashift.llm.conversation_repair import (
    END,
    SPECULATIVE,
    Line,
    backward,
    closed,
    conversation_digests,
    damaged_and_repaired,
    fixed_up,
    parallel,
    repair_conversations,
    traced,
)

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over every edit at every row, three inserted
    rows in a line at most; rows are (role, text, fault)."""

    def grown(shape, initial):
        """The shape of what has come out, after one row more; none if it may not follow."""
        following = {"": "su", "s": "u", "u": "a", "a": "u"}
        return initial if initial in following[shape] else None

    @lru_cache(maxsize=None)
    def best(i, shape, room):
        found = []
        if i == len(rows) and shape in ("", "a"):
            found.append((0, "", ()))
        if room:
            for role in ("user", "assistant"):
                if grown(shape, role[0]):
                    found.append(after(3, "I", ((role, ""),), best(i, role[0], room - 1)))
        if i < len(rows):
            role, text, fault = rows[i]
            found.append(after(4, "D", (), best(i + 1, shape, 3)))
            if fault in (None, "truncated"):
                extra = 3 if fault else 0
                if grown(shape, role[:1] or "-"):
                    found.append(after(extra, "K", ((role, text),), best(i + 1, role[0], 3)))
                for other in ("user", "assistant"):
                    if grown(shape, other[0]):
                        found.append(after(3 + extra, "R", ((other, text),), best(i + 1, other[0], 3)))
        return min(found, default=(10**9, "", ()))

    def after(cost, letter, made, rest):
        return cost + rest[0], letter + rest[1], made + rest[2]

    return best(0, "", 3)


def judged(rows):
    """(role, text, first fault) of rows of (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        fault = None
        if not solid:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif solid[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def digest_of(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def expected(rows):
    """The query's row for rows of (turn, role, text) after damage, in order."""
    faults = judged([(r, t) for _, r, t in rows])
    counts = Counter(f for *_, f in faults)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, made = cheapest(tuple(faults))
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest_of(made))


def damage(rows):
    """Conversations of (conv, turn, role, text) after damage, in order of turns."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (role, text)]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        out[conv]
        if fault == 0:
            continue
        role, text = said
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, no long, at long, d1 string, conv string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d", "c", 3) for r in rows], SCHEMA).repartition(3)


def run(spark, rows):
    got = damaged_and_repaired(frame(spark, rows))
    assert got.columns == COLUMNS
    return Counter(map(tuple, got.collect()))


def talks(n, seed, roles=("user", "assistant", "user", "assistant", "system", "tool", "")):
    """Conversations of distinct turns, most in order and some not, some rows repeated."""
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = rng.choice(["Yes.", "No!", "", " \t", "cut off", "Really? ", f"{conv} and {turn}.", "Fine.\n"])
            rows.append((conv, turn + 3 * (rng.random() < 0.05) * 10, role, text))
    return [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(x[0], x[1]) for x in rows[:i]}]


@pytest.mark.parametrize("block", [12, 1])
def test_damaged_talks(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = talks(150, block)
    assert run(spark, rows) == Counter((c, *expected(r)) for c, r in damage(rows).items())


def test_missing_cells_and_repeated_rows(spark):
    rows = [
        (None, 1, "user", "Hello."), (None, 2, None, "Hi."), (None, 3, "assistant", None),
        (7, None, "user", "Hello."), (7, 4, "assistant", "Hi!"), (8, None, None, None),
        (9, 2, "user", "Same."), (9, 2, "user", "Same."), (9, 2, "user", "Same."), (9, 5, "assistant", "So."),
        (10, 1, "system", "Only this."), (11, -5, "user", " "), (11, 10**12, "assistant", "\U0001f600."),
        (12, 0, "user", "x" * 200_000 + "."), (12, 1, "assistant", "\x00!"), (13, 3, "sys", "S."), (13, 4, "ux", "U."),
        (13, 5, "abc", "A."),
    ]
    assert run(spark, rows) == Counter((c, *expected(r)) for c, r in damage(rows).items())


def test_empty_table_and_nothing_left(spark):
    assert run(spark, []) == Counter()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert run(spark, [(gone, 1, "user", "Hi.")]) == Counter([(gone, 0, 0, 0, 0, 0, 0, "", digest_of([]))])


def long_talk(kind, n):
    rng = random.Random(kind)
    if kind == "one role":
        return [("user", f"{i}.") for i in range(n)]
    if kind == "other role":
        return [("tool", f"{i}.") for i in range(n)]
    if kind == "same text":
        return [(("user", "assistant")[i % 2], "Yes.") for i in range(n)]
    if kind == "regular":
        return [(("user", "assistant")[i % 2], f"{i}.") for i in range(n)]
    return [(rng.choice(["user", "user", "assistant", "system", "tool"]), rng.choice([f"{i}.", f"{i}", "", "So."])) for i in range(n)]


KINDS = ["one role", "other role", "same text", "regular", "mixed"]


@pytest.fixture(scope="module")
def hot(spark):
    """Five long conversations among short ones, cut into chunks of eight rows."""
    rows = [(1000 + k, t, *x) for k, kind in enumerate(KINDS) for t, x in enumerate(long_talk(kind, 300))]
    return rows + [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in range(40) for t in range(4)]


def test_long_conversations_in_chunks(spark, monkeypatch, hot):
    monkeypatch.setattr(repair, "BLOCK", 3)
    found = repair_conversations(frame(spark, hot))
    audits = {r["conv"]: r.asDict() for r in found.audits.collect()}
    rows = defaultdict(list)
    for r in sorted(found.rows.collect(), key=lambda r: (r["no"], r["at"], r["place"])):
        rows[r["conv"]].append((r["role"], r["text"]))
    digests = {r["no"]: r["digest"] for r in conversation_digests(found.rows).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in hot:
        by_conv[conv].append((turn, role, text))
    for conv, talk in by_conv.items():
        lines = [Line(i, r[:1], [None, "blank", "duplicate", "truncated"].index(f), 1) for i, (r, _, f) in enumerate(judged([x[1:] for x in talk]))]
        edits = traced(lines, backward(lines, END), 0, True)
        got = audits[conv]
        assert got["audit"] == "".join(e.letters for e in edits)
        assert got["cost"] == sum(e.cost for e in edits)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(talk, talk[1:])]
        assert got["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        shape = "".join(r[:1] for r, _ in rows[conv])
        assert re.fullmatch("(s?(ua)+)?", shape)
        assert digests.get(got["no"], digest_of([])) == digest_of(rows[conv])


def test_passes_do_not_grow_with_a_conversation(spark, monkeypatch):
    """Chunks whose vectors never meet take a few passes, however many chunks there are."""
    passes = []
    plain = repair.stitched
    monkeypatch.setattr(repair, "stitched", lambda patient: passes.append(patient) or plain(patient))
    monkeypatch.setattr(repair, "BLOCK", 3)
    for n in (100, 800):
        repair_conversations(frame(spark, [(1, t, "user", f"{t}.") for t in range(n)])).audits.collect()
        assert len(passes) <= 8
        passes.clear()


row = st.tuples(st.sampled_from(["u", "a", "s", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3]))
vectors = st.lists(st.integers(0, 20), min_size=4, max_size=4).map(closed)


@settings(max_examples=300, deadline=None)
@given(st.lists(row, max_size=9))
def test_recursion_is_the_cheapest(rows):
    lines = [Line(i, r, f, 1) for i, (r, f) in enumerate(rows)]
    edits = traced(lines, backward(lines, END), 0, True)
    names = [None, "blank", "duplicate", "truncated"]
    cost, audit, _ = cheapest(tuple((r, "x", names[f]) for r, f in rows))
    assert (sum(e.cost for e in edits), "".join(e.letters for e in edits)) == (cost, audit)


@settings(max_examples=300, deadline=None)
@given(st.lists(row, max_size=30), vectors)
def test_a_fixed_up_chunk_is_one_run_from_the_true_vector(rows, end):
    lines = [Line(i, r, f, 1) for i, (r, f) in enumerate(rows)]
    assert fixed_up(lines, backward(lines, SPECULATIVE), end) == backward(lines, end)[0]
    assert parallel(closed(list(end)), end)


def test_whole_table(spark):
    path = TESTDATA / "sf0.01" / "conversations.parquet"
    if not path.exists():
        pytest.skip("needs the test tables")
    table = pq.read_table(path).to_pylist()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table]
    got = damaged_and_repaired(spark.read.parquet(str(path)))
    assert Counter(map(tuple, got.collect())) == Counter((c, *expected(r)) for c, r in damage(rows).items())
