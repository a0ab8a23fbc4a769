import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import bpe
from siftwell.llm import token_counts as C
from siftwell.llm.queries import QUERIES, RANKS, table

CODEC = bpe.codec(RANKS, public_tokenizers.PATTERN).prepare()
COUNTER = C.counter(CODEC)


def edited(text, edits):
    out, last = [], 0
    for s, e, r in C.in_order(edits, len(text)):
        out += [text[last:s], r]
        last = e
    return "".join([*out, text[last:]])


def check(text, edits):
    todo = C.in_order(edits, len(text))
    new, tree, _ = C.apply_edits(text, C.Tree.unpacked(C.build(text, COUNTER).packed()), todo, COUNTER)
    want = C.build(edited(text, edits), COUNTER)
    assert new == edited(text, edits)
    assert tree.lens.tolist() == want.lens.tolist() and tree.counts.tolist() == want.counts.tolist()
    assert tree.n_tokens == want.n_tokens == len(CODEC.encode(new)) // 4 and tree.n_chars == len(new)
    assert (tree.sums == C.Tree(tree.lens, tree.counts, tree.first).sums).all()
    return tree


letters = st.text(st.sampled_from("ab '’sre1 \n\t.é漢 "), max_size=60)


@settings(max_examples=400, deadline=None)
@given(letters, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70), letters), max_size=6))
def test_equals_counting_anew(text, edits):
    check(text, edits)


def test_long_texts_encode_little():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(20000))
    edits = [(p, p + r.randint(0, 9), "x y" * r.randint(0, 3)) for p in r.sample(range(len(text)), 50)]
    check(text, edits)
    todo = C.in_order(edits, len(text))
    tree = C.build(text, COUNTER)
    new, after, n = C.apply_edits(text, tree, todo, COUNTER)
    assert n < 1000
    for _ in range(5):  # trees stay right over many rounds
        todo = C.in_order([(p, p + 3, "word " * 40) for p in r.sample(range(len(new)), 20)], len(new))
        new, after, _ = C.apply_edits(new, after, todo, COUNTER)
        assert after.lens.tolist() == C.build(new, COUNTER).lens.tolist()


def test_whole_text_and_ends():
    for text, edits in (("", [(0, 0, "a b")]), ("a b", [(0, 3, "")]), ("a  ", [(3, 3, "b")]), ("abc", [(-5, 99, None), (None, 2, "x")])):
        check(text, edits)


def test_rows(spark):
    rows = [(1, "Call 555-123-4567 or a.b@c.org now", 5), (2, None, 6), (3, "", 7), (1, "Call 555-123-4567 or a.b@c.org now", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_edits int")
    got = C.recount(C.count(df, CODEC), CODEC, C.masks).collect()
    assert [r.text for r in got if r.doc_id == 1] == ["Call [NUMBER] or [EMAIL] now"] * 2
    assert {(r.doc_id, r.n_tokens, r.n_edits) for r in got if r.doc_id > 1} == {(2, 0, 0), (3, 0, 0)}
    given_edits = df.limit(2).selectExpr("doc_id", "text", "array(named_struct('start', 0, 'end', 4, 'replacement', 'Ring'), null) AS e")
    assert {r.text for r in C.recount(C.count(given_edits, CODEC), CODEC, "e").collect()} <= {"Ring 555-123-4567 or a.b@c.org now", "Ring"}
    assert C.recount(C.count(df.limit(0), CODEC), CODEC, C.masks).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        x = r.text or ""
        assert got[r.doc_id].n_tokens == len(enc.encode_ordinary(x))
        assert got[r.doc_id].n_tokens_edited == len(enc.encode_ordinary(edited(x, C.masks(x))))
