from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import leaks as K
from emberlog.llm import lookalikes as A
from emberlog.llm import packing as P

DOCS = "doc_id bigint, text string, lang string, source string, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"


def docs(spark, texts, source="s", boxes=None):
    return spark.createDataFrame([(i, t, "en", source, boxes) for i, t in enumerate(texts)], DOCS)


# --- visually identical text --------------------------------------------------------------------------------------------

CYR_A, CYR_O, ZWSP, NBSP, ACUTE, FULL_A = "а", "о", "​", " ", "́", "ａ"
SAME = ["a café on", f"a{NBSP}café on", f"{CYR_A} café {CYR_O}n", f"a c{ZWSP}afe{ACUTE} on", f"{FULL_A} café on"]
OTHER = ["A café on", "a cafe on", "a  café on", "a café 0n", "a café\non", "a café, on", "a café on.", "ab", "é", "e"]


def test_classes(spark):
    got = {tuple(r) for r in A.look_equal_pairs(docs(spark, SAME + OTHER)).collect()}
    n = len(SAME)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_equal_texts_are_no_case_but_share_a_form(spark):
    d = docs(spark, [SAME[0], SAME[0], SAME[1], None, "", ""])
    assert {tuple(r) for r in A.look_equal_pairs(d).collect()} == {(0, 2), (1, 2)}
    forms = {r.doc_id: r.form for r in A.consistent_forms(d).collect()}
    assert forms[0] == forms[1] == forms[2] and forms[3] is None and forms[4] == "" and len(forms) == 6


def test_ligatures_roman_numerals_and_other_scripts(spark):
    pairs = [("fir st", "ﬁr ﬆ"), ("clod", "ⅽⅼοⅾ"), ("НО", "HO"), ("ё", "ë"), ("xvi", "ⅹvi")]
    d = docs(spark, [x for p in pairs for x in p])
    assert {tuple(r) for r in A.look_equal_pairs(d).collect()} == {(2 * i, 2 * i + 1) for i in range(len(pairs))}


def test_letters_of_any_script(spark):
    pairs = [("oops", "\u2c9fops"), ("pin", "\u2ca3in"), ("cat", "\u1d04at"), ("old", "\u1d0fld"), ("in", "\u0131n"), ("Do", "\u15eao"), ("On", "\U00010404n"), ("me\u10fft", "meot"), ("Th\u0456s", "This")]
    d = docs(spark, [x for p in pairs for x in p])
    assert {tuple(r) for r in A.look_equal_pairs(d).collect()} == {(2 * i, 2 * i + 1) for i in range(len(pairs))}
    shape = A.shapes(spark)
    ascii_ = [chr(c) for c in range(128)]
    assert not set(ascii_) & set(shape)  # ordinary ASCII stays apart
    for a, b in shape.items():
        assert b not in shape, (a, b)  # heads are heads
        assert unicodedata.category(a)[0] == unicodedata.category(b)[0] == "L"
        for x in (a.lower(), a.upper()):
            assert x == a or len(x) > 1 or shape.get(x, x) != b, (a, x, b)  # case stays apart


def test_many_copies_in_chunks(spark):
    d = docs(spark, [SAME[0]] * 30 + [SAME[1]] * 20 + [SAME[2]])
    want = {(i, j) for i in range(51) for j in range(i + 1, 51) if (i < 30) != (j < 30) or (i < 50) != (j < 50)}
    assert {tuple(r) for r in A.look_equal_pairs(d, chunk=4).collect()} == want
    assert {r.form for r in A.consistent_forms(d.union(docs(spark, [None]))).collect()} == {SAME[0], None}


def test_forms_edge_tables(spark):
    assert A.look_equal_pairs(docs(spark, ["x"]).limit(0)).count() == 0
    assert A.consistent_forms(docs(spark, ["x"]).limit(0)).count() == 0
    long = "word " * 60_000
    assert A.look_equal_pairs(docs(spark, [long + "a", long + CYR_A])).count() == 1
    d = docs(spark, SAME[:2])
    for c in ("bare", "text_id", "form", "form_id", "printed", "look"):
        d = d.selectExpr("*", f"'x' as {c}")
    assert A.look_equal_pairs(d.union(d)).count() == 1  # repeated rows count once


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    table = {ord(k): v for k, v in A.same_shape().items()}
    swaps = [("a", CYR_A), ("o", "ο"), ("e", "ｅ"), (" ", NBSP), ("s", "s" + ZWSP), ("é", "é")]
    texts = []
    for _ in range(60):
        t = "".join(rnd.choice("aoes éx") for _ in range(4))
        for a, b in swaps:
            t = "".join(b if c == a and rnd.random() < 0.4 else c for c in t)
        texts.append(t)
    key = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFKD", t.replace(ZWSP, "")).translate(table))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if texts[i] != texts[j] and key(texts[i]) == key(texts[j])}
    assert {tuple(r) for r in A.look_equal_pairs(docs(spark, texts)).collect()} == want


# --- leaked passages ----------------------------------------------------------------------------------------------------

ITEM = "Formally the doubtful council opened some lock. Its window through Tinkel left the, rich captain. Towards this heavy voyage another mayor welcomed some mayor"
WORDS = ITEM.split()


def found(spark, texts, item=ITEM, boxes=None, **options):
    items = spark.createDataFrame([(7, "x", "en", item)], "item_id bigint, suite string, lang string, text string")
    return sorted(r.doc_id for r in K.leaked_passages(docs(spark, texts, boxes=boxes), items, **options).collect())


def test_runs_of_twelve(spark):
    head, tail = "Nothing of this is in", "any of the passages held out"
    cases = [
        f"{head} {' '.join(WORDS[3:15])} {tail}",  # twelve
        f"{head} {' '.join(WORDS[3:14])} {tail}",  # eleven
        f"{head}\n{' '.join(WORDS[2:8])}\n{' '.join(WORDS[8:16])}\n{tail}",
        f"{head}\n{' '.join(WORDS[2:8])} however {' '.join(WORDS[8:14])}\n{tail}",  # another word
        f"{head}\n{' '.join(WORDS[2:8])}\nApply Kelveltin, Linola Row\nper dozen 13s. 7d.\n{' '.join(WORDS[8:16])}\n{tail}",  # an advert
        f"{head}\n{' '.join(WORDS[0:8])} win-\ndow {' '.join(WORDS[9:16])}\n{tail}",  # a broken word
        f"{head} {' '.join(WORDS[3:15])} {tail}".upper().replace("WINDOW", "WIND0W").replace("COUNCIL", "CОUNCIL").replace("OPENED", "OPENOD"),  # misread
        " ".join(reversed(WORDS)),
    ]
    assert found(spark, cases) == [0, 2, 4, 5, 6]


def test_columns_given_line_by_line(spark):
    left = [" ".join(WORDS[0:5]), " ".join(WORDS[5:10]), " ".join(WORDS[10:14])]
    right = ["quite another thing is here", "that has no part in it", "and never had any"]
    lines = [x for pair in zip(left, right) for x in pair]
    boxes = [(100 if n % 2 == 0 else 600, 100 + 30 * (n // 2), 480 if n % 2 == 0 else 980, 125 + 30 * (n // 2), 0.9) for n in range(6)]
    assert found(spark, ["\n".join(lines)], boxes=boxes) == [0]


@pytest.mark.parametrize("lines", [1, 8, 9, 12, 30, 200])
def test_any_number_of_lines_is_passed_over(spark, lines):
    advert = "\n".join(f"Apply Kelveltin {n}, Linola Row" for n in range(lines))
    cases = [
        f"head\n{' '.join(WORDS[0:6])}\n{advert}\n{' '.join(WORDS[6:13])}\ntail",
        f"head\n{' '.join(WORDS[0:8])} win-\n{advert}\ndow {' '.join(WORDS[9:14])}\ntail",  # inside a broken word
        f"head\n{' '.join(WORDS[0:4])}\n{advert}\n{' '.join(WORDS[4:8])}\n{advert}\n{' '.join(WORDS[8:13])}\ntail",
        f"head\n{' '.join(WORDS[0:6])} other\n{advert}\n{' '.join(WORDS[6:13])}\ntail",  # another word before the lines
        f"head\n{' '.join(WORDS[0:11])}\n{advert}\ntail {WORDS[11]}",  # the twelfth word is not at a line's start
        f"head\n{' '.join(WORDS[0:11])}\n{advert}\n{WORDS[11]} tail",  # a chance word
    ]
    assert found(spark, cases) == [0, 1, 2]


def misread(words, places):
    return " ".join(w[:1] + "\u00f0" + w[2:] if n in places else w for n, w in enumerate(words))


def test_the_edit_budget_alone_decides(spark):
    rnd, letters = random.Random(1), [n for n, w in enumerate(WORDS[:12]) if len(w) > 1]
    places = [list(range(a, a + 5)) for a in range(6)] + [[0, 2, 4, 6, 9], [0, 3, 5, 7, 10]] + [rnd.sample(letters, 5) for _ in range(20)]
    places = [[n for n in p if n in letters] for p in places]
    assert found(spark, [misread(WORDS[:12], p) for p in places]) == list(range(len(places)))
    beyond = [rnd.sample(letters, 6) for _ in range(20)]
    assert found(spark, [misread(WORDS[:12], p) for p in beyond]) == []
    assert found(spark, [misread(WORDS[:12], letters[:2])], errors=1) == [] and found(spark, [misread(WORDS[:12], letters[:1])], errors=1) == [0]


def test_misread_letters_and_capitals(spark):
    item = "Der Fluß und die große Straße führten gestern den alten Markt nach Osten"
    text = item.upper()
    assert "STRASSE" in text
    assert found(spark, [text, item.replace("und", "uncl"), item.replace("und", "unb"), item.replace("alten", "kalten Osten")], item=item) == [0, 1, 2]
    russian = "Новый мост открыли вчера утром когда старый рынок уже давно был закрыт"
    swapped = russian.upper().translate(str.maketrans("МВКТНОРСХ", "MBKTHOPCX"))
    assert found(spark, [russian.upper(), swapped], item=russian) == [0, 1]


def brute(item, lines, least, errors):
    """All runs by plain search over one page without broken words."""
    words = [K.fold(w) for w in item.split()]
    page = [[K.fold(w) for w in x.split()] for x in lines]
    vocabulary = set(words)

    def edits(a, b):
        if a == b:
            return 0
        e = K.myers(a, b)
        return e if b not in vocabulary and e <= K.budget(a) else None

    def before(j, n, p):
        place = (n, p - 1) if p else (n - 1, len(page[n - 1]) - 1)
        return j == 0 or place[0] >= 0 and edits(words[j - 1], page[place[0]][place[1]]) is not None

    def run(j, n, p, left, text, first, stretches, alone=True):
        """Does the page print words[j:first+least] from line n, word p on?"""
        if j == first + least:
            size = least // (errors + 1)
            return K.myers("".join(words[first:j]), text) <= min(errors, sum(x // size for x in stretches) - 1)
        for m, q in [(n, p)] if p < len(page[n]) else [(m, 0) for m in range(n + 1, len(page))]:
            e = edits(words[j], page[m][q])
            if e is None or e > left:
                continue
            straight = m <= n + 1
            after = (m, q + 1) if q + 1 < len(page[m]) else (m + 1, 0)
            if not straight and not alone:  # one word at the run's begin, then lines passed over
                continue
            if not straight and j + 1 < len(words) and not (after[0] < len(page) and edits(words[j + 1], page[after[0]][after[1]]) is not None):
                continue
            more = [*stretches[:-1], stretches[-1] + 1] if straight else [*stretches, 1]
            if run(j + 1, m, q + 1, left - e, text + page[m][q], first, more, j > first or before(j, m, q)):
                return True
        return False

    return any(run(j, n, p, 2 * errors, "", j, [0]) for j in range(len(words) - least + 1) for n in range(len(page)) for p in range(len(page[n])))


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_plain_search(seed):
    rnd = random.Random(seed)
    names = ["anna", "bell", "cart", "dome", "east", "fern", "gold", "hill"]
    for _ in range(300):
        item = " ".join(rnd.choice(names) for _ in range(9))
        words = item.split()
        stream = [rnd.choice(["zzzz", "yyyy"]) for _ in range(3)] + words[rnd.randint(0, 3) : rnd.randint(6, 9)] + ["xxxx"]
        stream = [w[0] + "q" + w[2:] if rnd.random() < 0.15 else w for w in stream]
        lines = []
        while stream:
            n = rnd.randint(2, 4)
            lines.append(" ".join(stream[:n]))
            stream = stream[n:]
            while rnd.random() < 0.4:
                lines.append(" ".join(rnd.choice(["vvvv", "wwww", *names[:2]]) for _ in range(3)))
        items = K.Items([(1, item)], 6, 2)
        got = bool(K.leaks(items, [K.Page([K.fold(x) for x in lines])]))
        assert got == brute(item, lines, 6, 2), (item, lines)


def test_leak_edge_tables(spark):
    assert found(spark, [None, "", "x", "-", "\n\n"]) == []
    assert found(spark, [ITEM], item="too short") == [] and found(spark, [ITEM], item=None) == []
    assert found(spark, [ITEM + "\n" + ITEM]) == [0]
    assert found(spark, ["filler words all along the way " * 20_000 + ITEM]) == [0]
    with pytest.raises(ValueError):
        found(spark, [ITEM], max_item_words=3)
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    d = docs(spark, [ITEM]).selectExpr("*", "1 as item_id", "2 as line")
    assert K.leaked_passages(d.union(d), items.union(items)).count() == 1
    assert K.leaked_passages(d.limit(0), items).count() == 0 and K.leaked_passages(d, items.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abcd", max_size=9))
def test_myers_is_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert K.myers(a, b) == row[-1]


# --- containers ---------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_holds_everything_once(sizes):
    bins = P.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1 + 1.7 * sum(sizes) / 100  # any-fit bound


def packed(spark, texts, **options):
    options = {"capacity": 32, "window": 8, "run": 4, "bucket_rows": 50} | options
    df = spark.createDataFrame([(i, t, "en", ["x", "y", None][i % 3], None) for i, t in enumerate(texts)], DOCS)
    return P.pack(df, **options).collect()


def test_containers(spark):
    rnd = random.Random(3)
    texts = [" ".join(["word"] * rnd.randint(1, 40)) for _ in range(300)] + [None, ""]
    encode = P.load_tokenizer(P.TOKENIZER).encode_ordinary
    sizes = {i: len(encode(t)) for i, t in enumerate(texts) if t}
    got = packed(spark, texts)
    parts, fill = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, {})[r.piece] = r.n_tokens
        fill.setdefault(r.container, []).append((r.place, r.n_tokens))
    assert {d: sum(p.values()) for d, p in parts.items()} == sizes
    assert all(len(p) == -(-sizes[d] // 32) for d, p in parts.items())  # split only what is longer than a container
    for c in fill.values():
        at = 0
        for place, n in sorted(c):
            assert place == at
            at += n
        assert at <= 32
    assert len(fill) <= 1.08 * sum(sizes.values()) / 32 + 2


def by_hand(items, shares, window_tokens):
    """Deficit round-robin as a loop: (source, tokens) in queue order -> window of each item."""
    queues = {s: [n for n, it in enumerate(items) if it[0] == s] for s in shares}
    left, credit, out, filled = {s: sum(items[n][1] for n in q) for s, q in queues.items()}, dict.fromkeys(shares, 0.0), {}, 0.0
    steps = 20_000  # credit is given in small steps, so that a source that runs dry leaves its share at once
    while any(queues.values()):
        alive = [s for s in shares if left[s] > 1e-9]
        total = sum(shares[s] for s in alive)
        for s in alive:
            give = min(window_tokens / steps * shares[s] / total, left[s])
            credit[s] += give
            left[s] -= give
        filled += window_tokens / steps
        for s in shares:
            while queues[s] and items[queues[s][0]][1] <= credit[s] + 1e-6:
                n = queues[s].pop(0)
                credit[s] -= items[n][1]
                out[n] = max(0, -(-int(round(filled / window_tokens * steps)) // steps) - 1)
    return out


@pytest.mark.parametrize("targets", [None, {"x": 0.5, "y": 0.5}, {"x": 0.7, "y": 0.2}, {"y": 1.0}])
def test_windows_are_those_of_deficit_round_robin(spark, targets):
    rnd = random.Random(2)
    rows = [(i, 0, rnd.choice(["x", "x", "x", "y", None]), rnd.randint(1, 32), i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, source string, n_tokens bigint, h bigint")
    got = {r.doc_id: r.window for r in P.drawn(df, capacity=32, window=8, targets=targets, bucket_rows=10_000).collect()}
    tokens = {s: sum(r[3] for r in rows if r[2] == s) for s in ("x", "y", None)}
    want = by_hand([(r[2], r[3]) for r in rows], P.shares_of(tokens, targets), 256.0)
    assert len(got) == 400 and sum(got[i] != want[i] for i in range(400)) <= 4  # the loop's steps are coarse
    other = {r.doc_id: r.window for r in P.drawn(df.withColumn("h", df["h"] * 7), capacity=32, window=8, targets=targets, bucket_rows=10).collect()}
    assert sorted(other) == sorted(got) and max(other.values()) == max(got.values())


def test_every_window_holds_the_mixture(spark):
    rnd = random.Random(4)
    texts = [" ".join(["word"] * rnd.randint(1, 30)) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, "en", "xxxxxyyz"[i % 8], None) for i, t in enumerate(texts)], DOCS)
    packed = P.pack(df, capacity=64, window=64, run=4, bucket_rows=200)
    r = P.mixture_report(packed, capacity=64).first()
    assert r.windows >= 8 and r.worst <= 0.1 and r.containers <= 1.01 * r.ideal
    shares = {(x.window, x.source): x.share for x in P.mixture(P.pack(df, capacity=64, window=64, run=4, targets={"x": 0.4, "y": 0.4, "z": 0.2})).collect()}
    assert all(abs(shares[w, s] - t) < 0.05 for w in range(5) for s, t in (("x", 0.4), ("y", 0.4), ("z", 0.2)))  # until y runs dry


def test_packing_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert P.pack(empty).count() == 0
    assert {r.container is not None for r in packed(spark, ["a"])} == {True}
    long = packed(spark, ["word " * 5000])
    assert len({r.container for r in long}) == len(long) and sum(r.n_tokens for r in long) == len(P.load_tokenizer(P.TOKENIZER).encode_ordinary("word " * 5000))
    d = docs(spark, ["one two three"]).selectExpr("*", "1 as part", "2 as h", "3 as n_tokens", "4 as container")
    assert P.pack(d, targets={"s": 1.0}).count() == 1
