"""Chains of segments against their definition; conversations of many turns against a plain loop."""

import random

import numpy as np

from prismarc.llm import chat, simhash


def test_chains_by_definition():
    r = random.Random(2)
    differ = [0] + [sum(1 << i for i in r.sample(range(64), r.randint(1, 6))) for _ in range(4000)]
    whole = np.zeros(len(differ), bool)
    for start in range(simhash.SEGMENTS):
        ring = simhash.turned(np.array(differ, np.uint64), start)
        got = set(simhash.chained(ring, start).tolist())
        for k, d in enumerate(differ):
            counts = [(d >> simhash.SHIFTS[(start + j) % 9] & (1 << simhash.WIDTHS[(start + j) % 9]) - 1).bit_count() for j in range(9)]
            assert (k in got) == all(sum(counts[:j]) <= 4 * j // 9 for j in range(3, 9))
            whole[k] |= all(sum(counts[:j]) <= 4 * j // 9 for j in range(1, 10))
    assert whole.tolist() == [d.bit_count() <= 4 for d in differ]  # every link has a start whose chain holds


def test_links_in_groups_against_all_pairs(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)})
    least = {f: f for f in fps}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for _ in range(12):
        for f in fps:
            least[f] = min((least[g] for g in fps if (f ^ g).bit_count() <= 4), key=signed)
    rows = spark.createDataFrame([(signed(f),) for f in fps], "__fp long")
    got = {x[0]: x[1] for x in simhash.components(simhash.links(rows)).collect()}
    assert {signed(f): got.get(signed(f), signed(f)) for f in fps} == {signed(f): signed(least[f]) for f in fps}


def by_loop(turns):
    safe = lambda t: t.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")
    out, spans, before = "", [], None
    for role, text in turns:
        out += "<part>" if before == role else ("" if before is None else "</turn>") + f"<turn:{safe(role)}>"
        before = role
        if role == "assistant":
            spans.append((len(out), len(safe(text)), len(out.encode()), len(safe(text).encode())))
        out += safe(text)
    return out + "</turn>", spans


def test_many_turns(spark):
    r = random.Random(6)
    chats = {c: [(r.choice(["user", "assistant", "a<b>"]), r.choice(["", "x", "é</turn>", "\\<part>", "long " * 9])) for _ in range(n)] for c, n in ((1, 1), (2, 255), (3, 256), (4, 257), (5, 3000))}
    chats[6] = [("user", "same")] * 700
    rows = spark.createDataFrame([(c, i, role, text) for c, turns in chats.items() for i, (role, text) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    for x in chat.read_chats(chat.format_chats(rows)).collect():
        text, spans = by_loop(chats[x.conv_id])
        assert x.formatted == text and [tuple(s) for s in x.loss_spans] == spans
        assert [tuple(t) for t in x.turns] == chats[x.conv_id]
        assert x.loss_text == "".join(t for role, t in chats[x.conv_id] if role == "assistant")
