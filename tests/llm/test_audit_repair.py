"""The repair of conversations against a plain search over whole audit strings."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from strophe.llm import audit_repair
from strophe.llm.audit_repair import Audits, damage, op12_audit_repair, repair, report

TURNS = "conv_id long, turn long, role string, text string, kind int, copies string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """(gaps ... sha256) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else None
        faults.append(fault or ("truncated" if shown[-1] not in ".!?" else None))
        seen.add((role, text))
    made = {"": "u", "s": "u", "a": "u", "u": "a"}

    @cache
    def best(i, state, inserted):
        """The cheapest (cost, audit, repaired) from row i on."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            c, a, t = best(i, made[state], inserted + 1)
            ways.append((c + 5, "I" + a, ({"u": "user:", "a": "assistant:"}[made[state]], *t)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] else 0
                if (state, role[:1]) in STEP:
                    c, a, t = best(i + 1, STEP[state, role[:1]], 0)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, made[state], 0)
                new = {"u": "user", "a": "assistant"}[made[state]]
                ways.append((c + 1 + extra, "R" + a, (f"{new}:{text}", *t)))
        return min(ways, default=(1 << 40, "", ()))

    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, texts = best(0, "", 0)
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(texts).encode()).hexdigest())


def by_conversation(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


def odd_rows(conversations=120):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why", "", "  ", None, "One two.\n", "Ünd…", "three?  ", "Yes. "]
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randint(1, 12)):
            turn = rng.choice([None, rng.randint(0, 9), rng.randint(-5, 40)])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("size", [1, 3, 2048])
def test_repair_matches_plain_search(spark, size):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    got = report(repair(damage(frame), size=size)).collect()
    want = {c: plain(tuple(r)) for c, r in by_conversation(damaged(rows)).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_long_conversation_over_pieces_and_tasks(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, 300)}.") for t in range(900)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {s: [tuple(r) for r in report(repair(frame, size=s)).collect()] for s in (7, 2048)}
    assert got[7] == got[2048] and len(got[7]) == 1
    audit = got[7][0][7]
    assert set(audit) <= set("KRDI") and audit.count("I") + 900 == len(audit)


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_audit_repair(spark, sf)
    assert got.columns == COLUMNS
    groups = by_conversation(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {c: plain(tuple(groups[c])) if c in groups else nothing for c in {r[0] for r in rows}}
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_dropped_conversations_and_empty_tables(spark, tmp_path):
    none = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    form = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(none, 0, "user", "Hi.")], form).write.parquet(str(tmp_path / "a/conversations.parquet"))
    row = op12_audit_repair(spark, str(tmp_path / "a")).collect()
    assert [tuple(r) for r in row] == [(none, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    spark.createDataFrame([], form).write.parquet(str(tmp_path / "b/conversations.parquet"))
    assert op12_audit_repair(spark, str(tmp_path / "b")).count() == 0


def test_trail_holds_the_texts(spark):
    frame = spark.createDataFrame([(5, 0, "user", "Hi."), (5, 1, "user", "Hi."), (5, 2, "assistant", "Well.")],
                                  "conv_id long, turn long, role string, text string")
    got = [(r["edit"], r["role"], r["text"], r["fault"], r["cost"]) for r in repair(frame).collect()]
    assert got == [("K", "user", "Hi.", None, 0), ("D", None, "Hi.", "duplicate", 2), ("K", "assistant", "Well.", None, 0)]


@pytest.mark.parametrize("mod", [Audits.MOD, 3])
def test_audits_compare_as_strings(monkeypatch, mod):
    """Also where nearly all hashes collide."""
    monkeypatch.setattr(Audits, "MOD", mod)
    rng = random.Random(1)
    audits, nodes, texts = Audits(), [0], [""]
    for _ in range(400):
        at = rng.randrange(len(nodes))
        letter = rng.choice("DIKR")
        if texts[at] + letter in texts:
            continue
        nodes.append(audits.add(nodes[at], letter))
        texts.append(texts[at] + letter)
    for _ in range(3000):
        i, j = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert audits.less(nodes[i], nodes[j]) == (texts[i] < texts[j])
        assert audits.text(nodes[i]) == texts[i]


def test_size_of_a_piece_is_bounded():
    assert audit_repair.PIECE <= 4096
