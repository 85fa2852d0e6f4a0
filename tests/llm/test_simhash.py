import random
from collections import defaultdict

import xxhash

from corpusloom.llm.components import components
from corpusloom.llm.simhash import fingerprint, grids, groups_for, keep_representatives, links, simhash_components
from tests.llm.conftest import HARD


def slow(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(prints, radius=2):
    nodes = sorted(set(prints))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [(i, slow(t)) for i, t, *_ in rows]
    root = labels([f for _, f in prints])
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[root[f]].append(i)
    return sorted(((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in prints), key=repr)


def test_against_brute_force(hard, clashing):
    for docs in (hard, clashing):
        assert sorted(map(tuple, simhash_components(docs).collect()), key=repr) == brute(HARD)


def test_empty(empty):
    assert simhash_components(empty).collect() == []
    assert keep_representatives(empty).collect() == []


def test_fingerprint_ignores_ascii_case_and_space_only():
    assert fingerprint(b"A b  C\nd") == fingerprint(b"a B c d") == slow("a b c d")
    assert fingerprint("É b c d".encode()) != fingerprint("é b c d".encode())
    assert fingerprint(b"") == fingerprint(b" \n") == 0


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_links_give_the_components_of_all_pairs(spark):
    """Random fingerprints, chains of one- and two-bit steps, and one cell so full that it takes the linear way."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(15):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3))))
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a)}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for radius in (2, 1, 0):
        found = {r.node: r.root for r in components(links(frame, radius)).collect()}
        want = labels([signed(p) & (1 << 64) - 1 for p in prints], radius)
        groups = defaultdict(set)
        for p in prints:
            groups[found.get(signed(p), signed(p))].add(p)
        wanted = defaultdict(set)
        for p, r in want.items():
            wanted[r].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_pairs_within_the_radius_share_a_grid_cell():
    rng = random.Random(5)
    pop = lambda x: sum(((x >> 2 * i & 1) + (x >> (2 * i + 1) & 1)) << 2 * i for i in range(32))
    for radius in (0, 1, 2):
        for n in (10, 10**6, 2 * 10**10):
            masks = grids(radius, groups_for(n, radius))
            for _ in range(100):
                a = rng.getrandbits(64)
                b = a ^ sum(1 << k for k in rng.sample(range(64), radius))
                assert any((pop(a) ^ pop(b)) & m & (1 << 64) - 1 == 0 for m in masks)


def test_cells_stay_small_as_the_input_grows():
    """The grid gets finer: the share of unrelated pairs that meet in a cell falls as 1 / n."""
    rng = random.Random(8)
    pop = lambda x: sum(((x >> 2 * i & 1) + (x >> (2 * i + 1) & 1)) << 2 * i for i in range(32))
    assert [groups_for(n, 2) for n in (10, 10**5, 10**8, 2 * 10**10)] == sorted(groups_for(n, 2) for n in (10, 10**5, 10**8, 2 * 10**10))
    for n in (1000, 20_000):
        prints = [pop(rng.getrandbits(64)) for _ in range(n)]
        for mask in grids(2, groups_for(n, 2)):
            assert len({p & mask & (1 << 64) - 1 for p in prints}) > 0.6 * n


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1000), (1001, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_one_row_of_each_group_stays(make_docs, hard, clashing):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (3, text), (9, "other words are here now"), (None, text), (None, "alone without an id")]
    kept = keep_representatives(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(3, text), (9, "other words are here now"), (None, "alone without an id")], key=repr)
    assert keep_representatives(clashing).columns == clashing.columns
    assert len(keep_representatives(hard).collect()) == len({(x[2]) if x[2] is not None else x[1] for x in brute(HARD)})
