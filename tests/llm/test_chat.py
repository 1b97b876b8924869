import random

import pytest

from gradpath.llm import chat


def brute(data):
    convs = {}
    for c, t, r, x in {(c, t, r or "", x or "") for c, t, r, x in data}:
        convs.setdefault(c, []).append(((t is not None, t), r, x))
    seqs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        same = [k for k, o in seqs.items() if o == s]
        if not longer and c == min(same, key=lambda k: (k is None, k or 0)):
            out[c] = ("".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s), len(same))
    return out


@pytest.mark.parametrize("segment,block", [(64, 1024), (2, 3)])
def test_against_brute_force(spark, segment, block):
    rng = random.Random(3)
    base = [[("user", f"q{k}"), ("assistant", f"a{k}"), ("user", None), (None, "z"), ("assistant", "")] for k in range(4)]
    data = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate((base[c % 4] * 3)[: rng.randint(1, 12)])]
    data += data[:7] + [(None, 0, "user", "q0"), (None, None, "user", "nothing"), (70, 5, "user", "tie"), (70, 5, "assistant", "tie")]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for r in sorted(chat.render(turns, segment, block).collect(), key=lambda r: r["segment"]):
        text, _ = got.get(r["conv_id"], ("", 0))
        got[r["conv_id"]] = (text + r["text"], r["copies"])
        assert r["n_turns"] <= segment
    assert got == brute(data)


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_many_rows_under_one_turn_or_none(spark):
    data = [(1, None, "user", f"t{k % 50}x{k}") for k in range(200)] + [(None, 3, "user", f"n{k}") for k in range(150)] + [(2, 0, "user", "a")]
    got = chat.render(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string"), 40, 32).collect()
    texts = {}
    for r in sorted(got, key=lambda r: r["segment"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
    assert texts == {c: v[0] for c, v in brute(data).items()}
