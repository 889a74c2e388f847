import random
import re

import pytest

from surgecast.llm import graph, linededup, minhash

from .common import awkward, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def near_copies(seed, groups=6, size=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = sentence(rng, 60).split()
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((1000 + 100 * g + k, " ".join(w)))
    return rows


def smallest_reachable(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if sets[i] and name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [(str(name), len(sets[i]), str(least.get(find(i), name) if sets[i] else name)) for i, (name, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [4, 5])
@pytest.mark.parametrize("limits", [None, (5, 300)])
def test_groups_as_brute_force(spark, monkeypatch, width, limits):
    rows = awkward(2) + near_copies(width)
    if limits:  # lists and clusters cut into chunks
        monkeypatch.setattr(minhash, "LIST_LIMIT", limits[0])
        monkeypatch.setattr(minhash, "CLUSTER_LIMIT", limits[1])
    got = minhash.near_duplicates(frame(spark, rows, ["set_id", "component", "post", "a"]), width=width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(smallest_reachable(rows, width))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_and_blank_tables(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0
    rows = minhash.near_duplicates(frame(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert all(r.kept and r.n_shingles == 0 and r.component_id == r.doc_id for r in rows)
    assert linededup.dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def passages(seed=5):
    """Documents with their own text, some with a shared passage, in lines or within a line."""
    rng = random.Random(seed)
    shared = [sentence(rng, 70), "\n".join(sentence(rng, 9) for _ in range(8)), sentence(rng, 55) + ".\n" + sentence(rng, 40)]
    rows, own = [], {}
    for i in range(60):
        before, after = sentence(rng, rng.randint(5, 80)), sentence(rng, rng.randint(5, 80))
        which = i % 5
        own[i] = (before, after)
        if which < 3:
            glue = "\n" if i % 2 else " "
            rows.append((i, before + glue + shared[which] + glue + after))
        else:
            rows.append((i, before + "\n" + after))
    return rows, shared, own


def test_shared_passages_stay_once(spark):
    rows, shared, own = passages()
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows, ["h", "key", "word", "_x"])).collect()}
    for k, passage in enumerate(shared):
        holders = [i for i, _ in rows if i % 5 == k]
        assert [i for i in holders if " ".join(passage.split()) in " ".join(got[i].text.split())] == holders[:1]
    for i, t in rows:
        if i % 5 > 2 or i < 3:
            assert got[i].text == t and got[i].removed_words == 0
        else:  # what is the document's own stays, but for a word that happens to go on alike
            left = " ".join(got[i].text.split())
            assert " ".join(own[i][0].split()[:-3]) in left and " ".join(own[i][1].split()[3:]) in left
            assert len(got[i].text.split()) == len(t.split()) - got[i].removed_words


def test_what_goes_is_repeated_elsewhere(spark):
    rows = [(i, t) for i, t in awkward(6) if i not in (7, 8)] + near_copies(11, 3, 8)
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows)).collect()}
    texts = dict(rows)
    for i, r in got.items():
        if r.removed_words:
            earlier = " ".join(" ".join((t or "").split()) for j, t in texts.items() if j is not None and (i is None or j < i))
            left = r.text.split()
            # at least one long stretch of the text stands in an earlier document
            w = texts[i].split()
            assert any(" ".join(w[k : k + 25]) in earlier for k in range(max(1, len(w) - 24)))
            assert len(left) == len(w) - r.removed_words
        else:
            assert r.text == texts[i]
    assert got[4].text == "" and got[3].text == texts[3]


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(1)
    t = sentence(rng, 80)
    rows = linededup.dedup(frame(spark, [(1, t), (1, t), (None, t), (2, t), (0, None)])).collect()
    by = {(r.doc_id, r.text) for r in rows}
    assert by == {(1, t), (2, ""), (None, ""), (0, None)} and sum(r.doc_id == 1 for r in rows) == 2


def own_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(n)]


def planted(seed, lengths, width=None, trials=12):
    """Pairs of documents that share a passage, inline or in lines of ``width`` words."""
    rng, rows, left = random.Random(seed), [], {}
    for n in lengths:
        for _ in range(trials):
            w = own_words(rng, n)
            shared = " ".join(w) if width is None else "\n".join(" ".join(w[k : k + width]) for k in range(0, n, width))
            glue = " " if width is None else "\n"
            for _ in range(2):
                a, b = own_words(rng, rng.randint(3, 80)), own_words(rng, rng.randint(3, 80))
                left[len(rows)] = (n, a + b)
                rows.append((len(rows), glue.join([" ".join(a), shared, " ".join(b)])))
    return rows, left


@pytest.mark.parametrize("width", [None, 9, 11, 12])
def test_passages_of_two_documents_are_found(spark, width):
    rows, left = planted(width or 1, (30, 33, 40, 51, 55, 60, 66), width)
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows)).collect()}
    for i, t in rows:
        n, own = left[i]
        assert (got[i].removed_words, got[i].text.split()) == ((n, own) if i % 2 else (0, t.split()))


def gone_by_brute_force(rows, least=30):
    """Words left of each text: a word goes if it lies in a window that stands at an earlier place."""
    seen, left = set(), {}
    for i, t in sorted(rows):
        w, gone = t.split(), set()
        for k in range(len(w) - least + 1):
            x = tuple(w[k : k + least])
            if x in seen:
                gone.update(range(k, k + least))
            seen.add(x)
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    return left


@pytest.mark.parametrize("seed", range(3))
def test_dedup_as_brute_force(spark, seed):
    """Passages cut out of one another, held by many documents between different neighbours."""
    rng, rows = random.Random(seed), []
    pool = own_words(rng, 600)
    for i in range(150):
        w = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(560)
            w += own_words(rng, rng.randint(0, 40)) + pool[at : at + rng.randint(10, 120)]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.text.split() for r in linededup.dedup(frame(spark, rows)).collect()}
    assert got == gone_by_brute_force(rows)


def test_blocks_of_short_lines_are_found(spark):
    """Lines of one word, and lines without blanks, of two documents."""
    rng, rows, left = random.Random(4), [], []
    blocks = [own_words(rng, n) for n in (30, 60, 120)] + [["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(20)) for _ in range(40)]]
    for block in blocks:
        for _ in range(2):
            a, b = own_words(rng, 20), own_words(rng, 20)
            left.append(a + b)
            rows.append((len(rows), "\n".join([" ".join(a), *block, " ".join(b)])))
    got = {r.doc_id: r.text.split() for r in linededup.dedup(frame(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == [left[i] if i % 2 else t.split() for i, t in rows]


def test_row_order_and_partitions_do_not_matter(spark):
    rng, rows = random.Random(8), []
    for n, width in [(30, 10), (33, 11), (40, 10), (44, 11), (33, 33)] * 6:
        w = own_words(rng, n)
        t = "\n".join(" ".join(w[k : k + width]) for k in range(0, n, width))
        rows += [(len(rows), t), (len(rows) + 1, t), (len(rows) + 2, " ".join(own_words(rng, 25)))]
    expected = [(i, "" if i % 3 == 1 else t) for i, t in rows]
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        got = linededup.dedup(frame(spark, rows).repartition(parts)).collect()
        assert sorted((r.doc_id, r.text) for r in got) == expected


@pytest.mark.parametrize("width", [None, 11])
def test_long_passages_leave_no_word(spark, width):
    rows, left = planted(21, (80, 88, 120, 121), width)
    got = {r.doc_id: r.text.split() for r in linededup.dedup(frame(spark, rows)).collect()}
    assert all(got[i] == left[i][1] for i, _ in rows if i % 2)


def test_floor_is_a_parameter(spark):
    rng = random.Random(3)
    line = " ".join(own_words(rng, 12))
    rows = [(i, " ".join(own_words(rng, 20)) + "\n" + line) for i in range(3)]
    for least, gone in ((30, 0), (10, 12)):
        assert [r.removed_words for r in linededup.dedup(frame(spark, rows), least=least).orderBy("doc_id").collect()] == [0, gone, gone]
