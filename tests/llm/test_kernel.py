import numpy as np

from siftwell.llm import _kernel as K


def hashes(raw, spans):
    data = np.frombuffer(raw, np.uint8)
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    return K.span_hash(K.lanes(data), a, b)


def test_hashes_depend_on_the_bytes_only():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000).astype(np.uint8).tobytes()
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 1000, 4000), rng.choice([0, 1, 2, 3, 7, 8, 9, 16, 17, 63, 64, 65, 128, 700, 2000], 4000))]
    together = hashes(raw, spans)
    seen = {}
    for (a, b), h in zip(spans, together.tolist()):
        assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen)
    for a, b in spans[:300]:
        assert hashes(b"xyz" + raw[a:b] + b"!" * 9, [(3, 3 + b - a)])[0] == seen[raw[a:b]]
    assert len(hashes(b"", [])) == 0 and len(hashes(b"", [(0, 0)])) == 1


def test_regular_sequences_do_not_cancel_out():
    """The Thue-Morse sequence and its complement, which every polynomial modulo a power of two mixes up from 1,024 on."""
    bits = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8)
    for n in (256, 1024, 2048, 4096):
        one, other = (97 + bits[:n]).tobytes(), (98 - bits[:n]).tobytes()
        assert hashes(one, [(0, n)])[0] != hashes(other, [(0, n)])[0]


def test_zero_bytes_count():
    own = [bytes(n) for n in range(0, 200)]
    assert len({int(hashes(x, [(0, len(x))])[0]) for x in own}) == 200
