import hashlib
import random
import re

from corpusloom.llm.pii import find_pii
from tests.llm.conftest import HARD


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base(text):
    """The base patterns as told, with their checks."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text if "@" in text else "")]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


TEXTS = [
    "a@b.c.@x.y z@z x@y@z.com a@b..c .@a.b _a@b.c_d@e.f",
    "😀 mail é.x@mail.example.com, ip 1.2.3.4.5.6.7.8 and 256.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111111111111111- 5 55",
    "+1 (988) 555-2485 +12 +1--------2 ++44 20 7946 0958 +1234567890123456 +1 1 1 1 1 1 1 1 1",
    "1" * 5000 + " " + "1 " * 5000 + "a" * 20000 + "@" + "+1" * 3000 + "1." * 2000,
    "x@y.z" * 50,
]


def brute(rows):
    out = []
    for i, t, *_ in rows:
        spans = base(t or "")
        count = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        out.append((i, *count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_base_spans(make_docs, clashing, empty):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    both = [*rows, *((None if i is None else 100 + i, t) for i, t, *_ in HARD)]
    for docs, want in ((make_docs(both), both), (clashing, HARD)):
        got = find_pii(docs).collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(want)
        for r in got:
            assert hashlib.sha256(",".join(s for s in r.spans.split(",") if s and not s.startswith("id:")).encode()).hexdigest() == r.base_sha256
    assert find_pii(empty).collect() == []


def test_very_long_runs(make_docs):
    rows = [(1, "7" * 300_000), (2, "a.b" * 100_000), (3, "a@" + "b." * 100_000 + "c"), (4, "+" + "1 " * 20_000), (5, "x1" * 150_000)]
    assert len(find_pii(make_docs(rows)).collect()) == 5


def test_contexts_discover_unseen_identifiers(make_docs):
    """'contact id' stands before e-mail addresses, and so names the handles, which no base pattern has; handles then vouch for 'handle is'."""
    rows = [(i, f"please contact id user{i}@mail.example.com for more") for i in range(40)]
    rows += [(100 + i, f"please contact id @user_{i}x for more") for i in range(4)]
    rows += [(200 + i, f"in the year {1000000 + i} nothing happened") for i in range(20)]
    got = {r.doc_id: r for r in find_pii(make_docs(rows)).collect()}
    for i in range(4):
        text = rows[40 + i][1]
        at = text.index("@user")
        assert got[100 + i].spans == f"id:{at}:{at + len(f'@user_{i}x')}" and got[100 + i].n_email == 0
    assert all(got[200 + i].spans == "" for i in range(20))
    assert all(got[i].n_email == 1 and "id:" not in got[i].spans for i in range(40))


def test_held_out_identifiers(make_docs):
    """Planted identifiers that no base pattern has, by the chain cards, long codes, the label before them, short secrets there."""
    rng = random.Random(4)
    vocabulary = ["river", "stone", "paper", "green", "walks", "under", "early", "seven", "light", "round"]
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    card = lambda: next(c for c in (str(rng.randint(10**15, 10**16 - 1)) for _ in iter(int, 1)) if luhn(c))
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    rows, planted = [], []
    for k in range(60):
        rows.append((k, f"{filler(9)} {card()} {filler(6)}"))
    for k in range(100, 160):
        secret = code() if k < 148 else f"pw-{rng.randint(10, 99)}x{k}"
        rows.append((k, f"{filler(5)} apikey = '{secret}', {filler(4)}"))
        planted.append((k, secret))
    for k in range(200, 260):  # numbers that are nobody's
        rows.append((k, f"{filler(5)} in the year {1000000 + k} and version 2.10.{k} {filler(3)}"))
    for k in range(300, 340):  # a part number that stands in very many places
        rows.append((k, f"{filler(3)} AB1234567890CD {filler(4)}"))
    got = {r.doc_id: r for r in find_pii(make_docs(rows)).collect()}
    found = {(i, x) for i, r in got.items() for x in r.spans.split(",") if x.startswith("id:")}
    texts = dict(rows)
    want = {(i, f"id:{texts[i].index(s)}:{texts[i].index(s) + len(s)}") for i, s in planted}
    assert len(found & want) / len(want) >= 0.95, "recall"
    assert len(found & want) / len(found) >= 0.95, "precision"
    assert not any("id:" in got[i].spans for i in range(60))


def test_neighbours_at_edges_and_beside_other_hits(make_docs):
    """An identifier at the begin of a text or right behind another one has its context, too."""
    rows = [(i, f"{10**8 + 7919 * i} +1 (555) 010-{1000 + i} ends") for i in range(8)]
    rows += [(50 + i, f"user{i}@mail.example.com ref{i}99 here") for i in range(8)]
    assert all(r.n_phone + r.n_email == 1 for r in find_pii(make_docs(rows)).collect())
