"""Conversation repair against a plain search over edits, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import pytest

from corpusloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, code int, fault string"
WS = " \t\n\x0b\x0c\r"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(WS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows):
    """The least (cost, audit, repaired) by breadth over all edits, at most two inserts before a row and at the end."""
    found = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted(nodes):
        for _ in range(2):
            for s, (c, a, t) in list(nodes.items()):
                for k in "ua":
                    if (s, k) in step:
                        to, new = step[s, k], (c + 5, a + "I", (*t, f"{name[k]}:"))
                        nodes[to] = min(nodes.get(to, new), new)
        return nodes

    for (role, text), fault in zip(rows, found, strict=True):
        best, new = inserted(best), {}
        for s, (c, a, t) in best.items():
            ways = [(s, (c + 2, a + "D", t))]
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if (s, role[:1]) in step:
                    ways.append((step[s, role[:1]], (c + more, a + "K", (*t, f"{role}:{text}"))))
                ways += [(step[s, k], (c + 1 + more, a + "R", (*t, f"{name[k]}:{text}"))) for k in "ua" if (s, k) in step]
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    """rows: (turn, role, text), as they are after nulls are filled and faults planted."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [r[1:] for r in rows]
    found, firsts = faults(pairs), [r[:1] for r, _ in pairs]
    cost, audit, text = search(pairs)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts)),
        cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
    )


def random_conversations():
    r = random.Random(11)
    texts = ["Yes.", "No!", "Why? ", "cut off", "cut, too \n", "", " \t", "One. two", "é…", "Fine.\x0b"]
    roles = ["user", "assistant", "system", "tool", "", "unknown", "User"]
    out = []
    for conv in range(300):
        weights = [8, 8, 2, 1, 1, 1, 1] if conv % 2 else [1] * 7
        for turn in range(r.randint(1, 9)):
            out.append((conv, None if r.random() < 0.05 else turn + r.randint(0, 1), r.choices(roles, weights)[0], r.choice(texts)))
    return out


def test_random_conversations(spark):
    rows = random_conversations()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    found = {r.conv_id: tuple(r)[1:] for r in repair.audits(df).collect()}
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    assert found == {k: expected(g) for k, g in groups.items()}
    turns = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(turns.get(k, [])).encode()).hexdigest() == v[-1] for k, v in found.items())


@pytest.mark.parametrize("part", [1, 2, 3, 7])
def test_distances_in_parts(part, monkeypatch):
    r = random.Random(part)
    monkeypatch.setattr(repair, "PART", part)
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(400):
        rows = [(names[r.choice([0, 1, 2, 2, 3, 3])], r.choice(["a.", "b", "", f"{k}.", f"{k}"])) for k in range(r.randint(0, 12))]
        kinds = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
        codes = bytes(kinds[f] << 2 | {"t": 0, "s": 1, "u": 2, "a": 3}[w[0]] for f, (w, _) in zip(faults(rows), rows, strict=True))
        cost, audit, _ = search(rows)
        assert repair.cheapest(codes) == (cost, audit)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, None, "Lo."), (2, None, "user", None), (3, 7, "user", "Long. " * 200_000), (3, 8, "assistant", "x" * 300_000), (4, 1, "system", "a.")]
    rows += [(5, 1, "user", "Same.")] * 3 + [(5, 1, "assistant", "Same.")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    found = {r.conv_id: tuple(r)[1:] for r in repair.audits(df).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert found == {k: expected(g) for k, g in groups.items()}
    assert repair.audits(df.limit(0)).collect() == [] == repair.repaired(df.limit(0)).collect()


def test_planted_faults(spark):
    rows = [(k, t, ["user", "assistant"][t % 2], f"Turn {t} of {k}. ok") for k in range(200) for t in range(1 + k % 4)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    groups = {}
    for conv, turn, role, text in rows:
        fault, group = zlib.crc32(f"{conv}:{turn}".encode()) % 20, groups.setdefault(conv, [])
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        group += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    found = {r.conv_id: tuple(r)[1:] for r in repair.audits(*repair.damaged(df)).collect()}
    assert found == {k: expected(g) for k, g in groups.items()}
    assert any(not g for g in groups.values()) and all(found[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k, g in groups.items() if not g)
