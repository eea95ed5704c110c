from types import SimpleNamespace

from hopwise.operators.fold import Session
from hopwise.streaming.verdicts import _Keys


class Store(dict):
    """A map of the state store that counts what it is asked for."""

    asked = 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def getValue(self, key):
        self.asked += 1
        return self[key]

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value


def hop(n, role, known):
    return SimpleNamespace(hop=n, role=role, source=f"s{n}", known=known)


def test_keys_of_many_batches_are_all_found_with_few_reads_and_writes():
    store, count, names = Store(), 0, [f"key{i}" for i in range(6_000)]
    for batch in range(60):
        keys = _Keys(Session(), store, count, new=batch == 0)
        keys.fold.risks[batch] = batch / 100
        keys.learn(hop(batch, "tool" if batch % 2 else "user", names[100 * batch : 100 * batch + 100]), False)
        keys.write()
        count = keys.count
        if batch == 0:
            assert store.asked <= 5
    assert count == 6_000 and max(v[0].count("key") for v in store.values()) < 200
    for i in (0, 63, 64, 399, 5_999):
        keys = _Keys(Session(), store, count)
        before = store.asked
        batch = i // 100
        want = [False, batch, f"s{batch}", batch / 100] if batch % 2 else [True, None, None, None]
        assert keys.entry(names[i]) == [*want, False, None, None, None] and keys.entry("none") is None
        assert keys.fold.risks == ({batch: batch / 100} if batch % 2 else {}) and store.asked - before < 20


def test_a_later_batch_keeps_the_first_place_of_a_key_and_its_doubt():
    store, first = Store(), _Keys(Session(), (s := Store()), 0, new=True)
    first.fold.risks[1], first.fold.doubtful["b"] = 0.5, (1, "s1")
    first.learn(hop(1, "tool", ["b"]), True)
    first.write()
    assert not store and len(s) == 1
    later = _Keys(Session(), s, first.count)
    assert later.entry("b") == [False, None, None, None, False, 1, "s1", 0.5] and later.fold.doubtful == {"b": (1, "s1")}
    later.fold.risks[2] = 0.0
    later.learn(hop(2, "tool", ["b"]), False)
    later.write()
    assert _Keys(Session(), s, later.count).entry("b") == [False, 2, "s2", 0.0, False, 1, "s1", 0.5] and later.count == 1
