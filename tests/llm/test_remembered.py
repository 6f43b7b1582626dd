import random

import numpy as np

from ordermart.llm import packing
from ordermart.llm.bpe import default_path
from ordermart.llm.remembered import LONGEST, Numbers, Pool, forget


def test_the_half_used_most_often_stays():
    numbers, pool = Numbers(), Pool()
    texts = ["rare", "x" * (LONGEST + 1), "often", "some", "twice"]
    codes = np.array([numbers[t] for t in texts])
    pool.add(np.arange(15, dtype="<u4"), np.array([1, 2, 3, 4, 5]))
    numbers.used(codes, np.array([1, 99, 9, 3, 2]))
    assert forget(numbers, [pool], 5) is None
    assert forget(numbers, [pool], 4).tolist() == [2, 3]  # long ones go first
    assert dict(numbers) == {"often": 0, "some": 1}
    assert numbers.uses.tolist() == [4, 1]
    assert [pool.ids(np.array([k])).tolist() for k in (0, 1)] == [[3, 4, 5], [6, 7, 8, 9]]
    assert numbers["new"] == 2
    assert numbers.new[-1] == "new"
    pool.add(np.arange(40, dtype="<u4"), np.array([40]))
    assert forget(numbers, [pool], 4).tolist() == [0, 1]  # few strings, many ids


def words(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(6)) + rnd.choice(["", ".", "é"]) for _ in range(n)]


def test_packing_remembers_a_bounded_number_and_the_frequent(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "BATCH", 16)
    e, rnd, sent = packing.Encoder(default_path()), random.Random(2), []
    codes = e.codes

    def counted(some):
        assert len(some) <= 16
        sent.extend(some)
        return codes(some)

    monkeypatch.setattr(e, "codes", counted)
    for _ in range(30):
        text = " ".join(["Often seen.", *words(rnd, 50), "often"])
        (ids, _), (none, _), (seen, _) = e.encode([text, "", "seen often."], 2)
        assert ids.tolist() == [*e.library.encode(text, add_special_tokens=False).ids, 2]
        assert none.tolist() == [2]
        assert seen.tolist() == [*e.library.encode("seen often.", add_special_tokens=False).ids, 2]
        assert max(len(e.numbers), len(e.stems)) <= 40 + 56
        assert len(e.ends) == len(e.numbers) == len(e.by_stretch.size)
    assert sent.count("often") == sent.count("seen") == 1
