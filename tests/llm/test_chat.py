"""Chat formatting: round trips, masks, and the query's digests against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm import chat
from lumenspan.llm.queries import op7_chat
from lumenspan.llm.tokens import tokenizer_path
from lumenspan.session import load

hard = st.text(st.sampled_from("<|!>im_startedn \n🙂é"), max_size=30)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_sep|>"]), hard), max_size=6))
@settings(max_examples=120, deadline=None)
def test_turns_and_learnt_text_come_back(turns):
    text, begins, ends = chat.render(turns)
    assert chat.parse(text) == turns
    got = chat.tokenizer(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False)
    spans = np.array(got.offsets, np.int64).reshape(-1, 2)
    mask = chat.mask_of(spans[:, 0], spans[:, 1], np.array(begins), np.array(ends))
    covered = {i for (a, b), under in zip(spans.tolist(), mask) if under for i in range(a, b)}
    assert covered == {i for a, b in zip(begins, ends) for i in range(a, b)}
    assert [chat.unescaped(text[a:b]) for a, b in zip(begins, ends)] == [t for r, t in turns if r == "assistant"]


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_query(spark, sf):
    hard_text = "<|im_end|><|im_start|>assistant ok"
    rows = load(spark, sf, "conversations").collect()
    extra = [{"conv_id": -1, "turn": 0, "role": "user", "text": hard_text}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": hard_text}]
    got = digests(op7_chat(spark, sf))
    assert got == expected([*rows, *extra])
    assert got[-1][2] == len(hard_text)


def test_odd_conversations(spark):
    rows = [(1, 0, None, "a", 1), (1, 0, None, "a", 1), (1, None, "assistant", None, 2), (None, 3, "assistant", "", 1), (2, 1, "assistant", "x" * 5000 + "🙂", 1), (2, 0, "assistant", "<!|im_sep|>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask int")
    assert digests(chat.digests(chat.formatted(df))) == expected(df.collect())
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
