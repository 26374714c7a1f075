"""Operators on texts against plain Python, with nulls, repeats and clashing columns."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hrefsieve.llm import bpe, licences, line_dedup, near_dedup, outliers, sharding
from hrefsieve.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_contiguous_and_even(docs, no_docs, texts):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    rows.sort(key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or 0 for r in rows] == sorted(i or 0 for i, _ in texts)
    total, before = sum(r.size for r in rows), 0
    for r in rows:
        assert r.shard == min(3, 4 * (2 * before + r.size) // (2 * total))
        before += r.size
    for s, n in Counter(r.shard for r in rows).items():
        assert [r.slot for r in rows if r.shard == s] == list(range(n))
    assert sharding.shard_by_bytes(no_docs).count() == 0


def brute_components(texts, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}
    for _ in ids:
        for i, x in sets:
            for j, y in sets:
                if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    return sets, root


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, no_docs, texts, width):
    sets, root = brute_components(texts, width, 80)
    rows = near_dedup.near_duplicates(docs, width).collect()
    want = Counter((i, len(x), root.get(i) if x or root.get(i) != i else i, i is None or root[i] == i) for i, x in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == want
    assert near_dedup.near_duplicates(no_docs, width).count() == 0
    left = near_dedup.one_of_each(docs, width)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert Counter(ids) == Counter({i: 1 for i in root if root[i] == i} | {None: 2})


def test_near_copies_in_large_groups(spark):
    """A chain of near copies and copies of copies, more than a heavy key's size."""
    from tests.llm.conftest import prose

    words, rows = prose(5, 100).split(), []
    for i in range(150):
        changed = list(words)
        for k in range(i % 13):
            changed[(7 * k + i) % 100] = f"w{i}x{k}"
        rows.append((i, " ".join(changed)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    _, root = brute_components(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in got} == root


def test_signature_distance_finds_all_keys():
    """Signatures within the distance share a key, by pigeonhole."""
    import random

    r = random.Random(3)
    for _ in range(500):
        differ = set(r.sample(range(near_dedup.INDEXED), near_dedup.DISTANCE))
        assert any(not differ.intersection(p) for p in near_dedup.PROBES)


LINES = st.lists(st.sampled_from("abcdefgh"), max_size=14)


@given(LINES, LINES)
@settings(max_examples=200, deadline=None)
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience(a, a) == [(i, i) for i in range(len(a))]


def test_line_dedup(docs, no_docs, texts):
    rows = {r.doc_id: r for r in line_dedup.report(docs.where("doc_id between 9 and 12 or doc_id in (1, 2, 3, 15)")).collect()}
    by = dict(texts)
    assert rows[10].text == by[10] and rows[1].text == by[1] and rows[2].text == by[2] and rows[15].text == by[15]
    assert rows[3].text == "" and rows[3].n_removed_words == 120
    assert rows[11].text == "\n".join([by[11].split("\n")[0], by[11].split("\n")[-1]])
    kept = line_dedup.without_common_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert {r.doc_id: r.text for r in kept.collect()}[4] is None
    assert line_dedup.report(no_docs).count() == 0


def all_pairs(rows):
    """What aligning each text with every earlier one deletes, and all lines in blocks of any earlier text."""
    aligned, blocks = {i: set() for i, _ in rows}, {i: set() for i, _ in rows}
    for later, text in rows:
        d = text.split("\n")
        for _, other in rows[:later]:
            e = other.split("\n")
            aligned[later].update(line_dedup.common_blocks(e, d, [len(x.split()) for x in d]))
            for i in range(len(e)):
                for j in range(len(d)):
                    n = 0
                    while i + n < len(e) and j + n < len(d) and e[i + n] == d[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in d[j : j + n]) >= line_dedup.BLOCK_WORDS:
                        blocks[later].update(range(j, j + n))
    return aligned, blocks


def deleted_lines(spark, rows):
    masks = line_dedup.common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {i: set() for i, _ in rows} | {r.doc_id: {k for k, x in enumerate(r.mask) if x} for r in masks}


def test_line_dedup_deletes_what_all_pairs_do(spark):
    """Passages that their first holder repeats, in other orders, and at random."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(4)
    p, x, y = (prose(300 + k, 12) for k in range(3))
    made = [[p, "own", p]] + [[f"u{k}", p, f"v{k}"] for k in range(5)] + [[x, y]] + [[f"s{k}", y, x, f"t{k}"] for k in range(4)]
    pool = [p, x, y, "", "one", "two words", "now three words", prose(310, 5), prose(311, 6)]
    made += [[r.choice(pool) for _ in range(r.randint(1, 9))] for _ in range(40)]
    rows = list(enumerate("\n".join(m) for m in made))
    got = deleted_lines(spark, rows)
    aligned, blocks = all_pairs(rows)
    assert all(aligned[i] <= got[i] for i, _ in rows)
    assert got == blocks
    assert all(got[i] == {1} for i in range(1, 6)) and all(got[i] == {1, 2} for i in range(7, 11))


def test_aligned_lines_keep_one_order(spark):
    """A later document that holds an earlier one's passages in order, then in another order, then twice."""
    from tests.llm.conftest import prose

    a, b, c, d = (prose(400 + k, 10) for k in range(4))
    rows = list(enumerate("\n".join(x) for x in ([a, b, c, d], ["one", a, "two", b, c, "three", d], [c, a, b, d], [a, "x", a])))
    masks = {r.doc_id: r for r in line_dedup.common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(masks) == {1, 2, 3}
    assert masks[1].mask == masks[1].aligned == [False, True, False, True, True, False, True]
    assert masks[2].mask == [True] * 4 and masks[2].aligned == [False, True, True, True]
    assert masks[3].mask == [True, False, True] and sum(masks[3].aligned) == 1


def test_line_dedup_of_blocks_of_short_lines(spark):
    """Verse and lists, no line of which has five words; empty lines within."""
    from tests.llm.conftest import prose

    words = prose(320, 60).split()
    verse = [" ".join(words[k : k + 4]) for k in range(0, 60, 4)]
    items = ["one", "", "two", "", "three", "four", "five"]
    made = [["first", *verse, "end"], ["other", *verse, "last"], ["x", *items, "y"], ["z", *items, "w"], ["one", "", "two", "", "three", "four"]]
    rows = list(enumerate("\n".join(m) for m in made))
    got = deleted_lines(spark, rows)
    assert got == {0: set(), 1: set(range(1, 16)), 2: set(), 3: set(range(1, 8)), 4: set()}
    assert got == all_pairs(rows)[1]


@given(st.lists(st.sampled_from(["", "a", "b c", "d e f g h", "i j k l"]), max_size=12))
def test_windows_are_shortest_runs(lines):
    n, words = len(lines), [len(x.split()) for x in lines]
    least = line_dedup.BLOCK_WORDS
    runs = {(i, j) for i in range(n) for j in range(i + 1, n + 1) if sum(words[i:j]) >= least}
    want = {(i, j) for i, j in runs if (i, j - 1) not in runs or (i + 1, j) not in runs}
    found = line_dedup.windows([x.encode() for x in lines])
    assert {(i, j) for _, i, j in found} == want
    keys = {}
    for key, i, j in found:
        assert keys.setdefault(key, lines[i:j]) == lines[i:j]
    assert len(keys) == len({tuple(lines[i:j]) for i, j in want})


def test_quality_counts(docs, no_docs, texts):
    rows = outliers.score(docs).collect()
    want = Counter()
    for i, t in texts:
        w = WORD.findall(t or "")
        n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(r.kept is not None and not (r.base_failed and r.kept) for r in rows)
    assert outliers.score(no_docs).count() == 0


def test_robust_distances_turn_outliers_away(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 60 + i), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(i, 80).split()), "en", "a") for i in range(60)]
    got = {r.doc_id: r.kept for r in outliers.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(60))


def test_licences(spark, docs, no_docs, texts):
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert all(r.licence is None and r.licences == [] for r in rows.values())
    notice, mit = licences.TEMPLATES["gpl-3.0-notice"], licences.TEMPLATES["mit"]
    made = [(1, f"Some of the text.\n{notice}\n{notice}"), (2, "x " * 3000 + mit.replace("copy", "replica", 1) + " y" * 3000), (3, "Released under the"), (4, " ".join(reversed(mit.split())))]
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert found[1].licence == "gpl-3.0-notice" and found[1].coverage == 1.0 and made[0][1][found[1].start : found[1].end] == notice.rstrip(".")
    assert found[2].licence == "mit" and found[2].coverage > 0.95
    assert found[3].licence is None and found[4].licence is None
    assert licences.scan(no_docs).count() == 0


def test_licences_equal_alignment_at_every_place(spark):
    """Edited notices in long texts: nothing is lost by looking at some words only."""
    import random

    r = random.Random(12)
    for name in ("gpl-3.0-notice", "mit-warranty", "bsd-2-clause"):
        template = licences.words_in(licences.TEMPLATES[name])
        scanner = licences.Scanner({name: licences.TEMPLATES[name]})
        missed = len(template) - -(-len(template) * 8 // 10)
        for _ in range(60):
            text = ["x"] * r.randrange(0, 300)
            notice = list(template)
            for k in r.sample(range(len(notice)), r.randrange(0, missed + 3)):
                notice[k] = "edited"
            at = r.randrange(0, len(text) + 1)
            text = text[:at] + notice + text[at:]
            slack, best = len(template) // 2 + 2, 0
            for lo in range(-len(template), len(text)):
                start = max(0, lo - slack)
                aligned = line_dedup.patience(text[start : lo + len(template) + slack], template)
                if len(aligned) >= licences.COVERAGE * len(template) and len(aligned) >= licences.DENSITY * (aligned[-1][0] - aligned[0][0] + 1):
                    best = max(best, len(aligned))
            found = scanner.scan(text)
            assert bool(found) == bool(best) and (not found or found[0][1] <= best)


TOKENIZERS = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return TOKENIZERS.Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordBpe(bpe.load_vocabulary(TOKENIZER))


@given(st.text(st.characters(exclude_categories=["Cs"], max_codepoint=0x24FF), max_size=60) | st.lists(st.sampled_from(["the", "'s", "<|endoftext|>", "<|startoftext|>", "Éa", "x1y", "ΑΣ", " ", "\n", "...", "thth", "inging"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(library, encoder, text):
    ids = encoder.encode_batch([text])[0]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_word_that_passes_the_pair_check_is_exact(encoder):
    """Letters at random: proposals that all pairs accept are what exact merging gives."""
    import random

    r = random.Random(1)
    words = {"".join(r.choice("thingeraou") for _ in range(r.randint(1, 14))) for _ in range(3000)}
    encoder.learn(words)
    for w in words:
        merged = encoder.merge([*w[:-1], w[-1] + encoder.suffix])
        assert [encoder.names[i] for i in np.frombuffer(encoder.memo[w], "<u4").tolist()] == merged == encoder.spelt[w].split(" ")


def test_bpe_equals_the_library_on_every_code_point(library, encoder):
    """Each between, before and after letters, alone, and twice."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 8192):
        texts = ["".join(f"a{c}b {c}{c} " for c in points[k : k + 16]) for k in range(low, min(low + 8192, len(points)), 16)]
        want = library.encode_batch(texts, add_special_tokens=False)
        for text, ids, there in zip(texts, encoder.encode_batch(texts), want, strict=True):
            assert ids == there.ids, [hex(ord(c)) for c in text]


def test_long_texts_and_characters_of_other_versions(library, encoder):
    text = "naïve Ĳ \u1c89x \U00010940y " * 4000
    (packed, decoded), = encoder.encode_packed([text])
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids and decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_in_spark(docs, no_docs, library, texts):
    encoded = bpe.encode(docs, TOKENIZER)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    decoded = Counter((r.doc_id, r.text) for r in bpe.decode(encoded, TOKENIZER).collect())
    assert decoded == Counter((i, library.decode(list(ids), skip_special_tokens=False)) for (i, ids), n in want.items() for _ in range(n))
    assert bpe.digests(no_docs, TOKENIZER).count() == 0


def test_bpe_learns_words_without_an_object_for_each(encoder):
    """The garbage collector walks over every list and tuple that stays; with one for each word that takes a third of the time."""
    import gc

    words = {f"{a}{b}{c}ungheit{i}" for i, (a, b, c) in enumerate(itertools.product(("re", "é", "stion", "ß", "漢"), ("th", "en", "ció"), [f"x{k}" for k in range(100)]))}
    gc.collect()
    gc.disable()
    try:
        before = gc.get_count()[0]
        encoder.learn(words)
        assert gc.get_count()[0] - before < len(words) / 10
    finally:
        gc.enable()
    for w in words:
        spelt = "".join(encoder.letters[b] for b in w.encode())
        exact = encoder.merge([*spelt[:-1], spelt[-1] + encoder.suffix])
        assert encoder.memo[w] == np.array([encoder.vocab[t] for t in exact], "<u4").tobytes()
        assert encoder._merged(spelt) == [encoder.vocab[t] for t in exact]
