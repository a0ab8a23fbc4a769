from collections import Counter

from siftwell.functions import text as T
from siftwell.functions.stemming import porter
from siftwell.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
#: Examples of the paper.
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_examples():
    assert {w: porter(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))
    assert [porter(w) for w in ("", "a", "is", "élan", "y")] == ["", "a", "is", "élan", "y"]


def test_query(spark):
    import re

    stop = set(T.ENGLISH)
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        want.update(porter(w) for w in re.findall(r"\w+", (r.text or "").lower()) if w not in stop)
    assert {r.stem: r.n for r in QUERIES["stem_porter"](spark, SF).collect()} == want
