"""Each operator against brute force or a round trip, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duelframe.llm import (
    bpe,
    decontaminate,
    html_graph,
    langid,
    lengths,
    ngram_join,
    queries,
    rotated_codes,
    sharding,
    suffix_index,
    wavelet,
)
from duelframe.llm.common import whole_text
from duelframe.llm.components import components

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None, "", " \n\t ", "Hello, WORLD's <|endoftext|>x<|end", "İ ſé ½ ¹² naïve", "ΑΣ ΟΔΟΣ ǅ ﬁ", "x" * 300 + "ab" * 200,
    "日本語 é ́x", "a\x1cb\x85c", "'s ''ll don't", "\xa0ÀÉ ß¼½² 12ab", "same text", "same text", "word " * 3000,
]
DOCS = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_jump_hash_moves_only_to_the_new_shard(spark):
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(7919)
    for n in (1, 2, 8, 100):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert set(a[a != b]) <= set(range(n)) and set(b[a != b]) == {n}
        assert np.bincount(a, minlength=n).min() > 0.8 * len(keys) / n
    rows = spark.createDataFrame([(k, "x") for k in [*range(500), None, 7, 7]], "doc_id long, v string")
    got = sharding.assign(rows.repartition(5), "doc_id", 8).collect()
    assert len(got) == 503
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    assert sharding.assign(rows.limit(0), "doc_id", 8).count() == 0


def test_bpe_equals_the_library(spark):
    model = bpe.WordBpe(PATH)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcTH é,.'1 \n") for _ in range(80)) for _ in range(200)]
    for _ in range(2):  # cold and warm
        ids, counts = model.encode_batch(texts)
        ends = np.cumsum(counts)
        for text, n, e in zip(texts, counts, ends, strict=True):
            assert ids[e - n : e].tolist() == library(text), text[:50]
    table = docs_of(spark, ODD).withColumn("IDS", F.lit("clash")).withColumn("other", F.lit(None).cast("int"))
    for r in bpe.encode_decode(table, PATH).collect():
        ids = library(ODD[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["other"] is None
        assert r["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(table.limit(0), PATH).count() == 0


def test_wavelet_matrix_and_shards(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 700, 70_000):
        values = rng.zipf(1.3, n) % 49_408
        matrix = wavelet.WaveletMatrix.build(values, 16)
        again = wavelet.WaveletMatrix.load(n, matrix.zeros.tolist(), matrix.pack())
        assert again.values().tolist() == values.tolist()
        for i in range(0, n, max(1, n // 9)):
            token = int(values[i])
            places = np.flatnonzero(values == token)
            assert again.access(i) == token and again.count(token) == len(places)
            assert again.select(token, len(places) - 1) == places[-1]
            assert again.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
    shards = wavelet.write_shards(docs_of(spark, ODD).repartition(3), PATH, 2, shard_tokens=50)
    got = sorted(wavelet.read_documents(shards).collect())
    start = 0
    for r, text in zip(got, ODD, strict=True):
        ids = np.array([*library(text), 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = wavelet.write_shards(docs_of(spark, ODD).limit(0), PATH, 2)
    assert wavelet.read_documents(empty).count() == 0


def test_lengths(spark):
    sums = lengths.suffix_sums(lengths.histogram(lengths.token_counts(docs_of(spark, ODD), PATH)))
    sizes = [len(library(t)) for t in ODD]
    got = {r["length"]: r for r in sums.collect()}
    assert got.keys() == set(sizes)
    for n, r in got.items():
        assert r["n_docs"] == sizes.count(n) and r["docs_at_least"] == sum(s >= n for s in sizes)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes) and r["docs_upto"] == sum(s <= n for s in sizes)
        assert r["tokens_at_least"] == sum(s for s in sizes if s >= n)
    assert [tuple(r) for r in lengths.quantiles(sums, [0.5, 1.0]).collect()] == [
        (0.5, sorted(sizes)[len(sizes) // 2 - 1]), (1.0, max(sizes)),
    ]
    cut = lengths.truncated_totals(lengths.histogram(lengths.token_counts(docs_of(spark, ODD), PATH)), [0, 13])
    assert [r["tokens"] for r in cut.collect()] == [0, sum(min(s, 13) for s in sizes)]


def test_language_by_cross_parsing(spark):
    rng = random.Random(3)
    kinds = {"aa": "kato mira sulo bende".split(), "bb": "xyth grolm spruft vlyk".split()}
    word = lambda lang: "".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(3, 700))), lang) for i in range(60) for lang in ("aa", "bb")]
    rows += [(900, None, "aa"), (901, "12 -- 3", "bb"), (902, "", None), (903, "мир", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("SCORE", F.lit("x"))
    model = langid.fit(table.where("doc_id < 40"))
    got = langid.identify(table, model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got if 40 <= r["doc_id"] < 900)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (900, 901, 902)} == {
        i: ("und", 0.0) for i in (900, 901, 902)
    }
    assert next(r for r in got if r["doc_id"] == 903)["lang_pred"] in kinds
    nothing = langid.fit(table.limit(0))
    assert {r["lang_pred"] for r in langid.identify(table, nothing).collect()} == {"und"}


def test_languages_of_many_letters(spark):
    rng = random.Random(8)
    letters = {"aa": range(0x4E00, 0x5000), "bb": range(0x9000, 0x9800), "cc": range(0x9000, 0x9800), "dd": range(0x61, 0x7B)}
    kinds = {lang: ["".join(chr(rng.choice(some)) for _ in range(3)) for _ in range(400)] for lang, some in letters.items()}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(40, 200))), lang) for i in range(60) for lang in kinds]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id < 40"))
    got = langid.identify(table.where("doc_id >= 40"), model).collect()
    assert len(got) == 80 and all(r["lang_pred"] == r["lang"] for r in got)


def test_letters_are_told_apart():
    for n in (0, 1, 253, 254, 3_000, 20_000):
        letters = "".join(sorted([chr(i) for i in range(0x110000) if chr(i).isalpha()][:n]))
        table = langid.symbol_table(letters)
        codes = {tuple(row) for row in table[[ord(c) for c in letters]].tolist()}
        assert len(codes) == n and (n > 253) == (table.shape[1] > 1)
        assert not codes & {(s, *[langid.NONE] * (table.shape[1] - 1)) for s in (langid.BLANK, langid.STRANGE)}


def test_suffix_automaton_parses_greedily():
    text = [3, 4, 3, 3, 5, 4, 3, 4, 5, 5, 3]
    table = langid.suffix_automaton(text, 6)
    joined = "".join(map(str, text))
    rng = random.Random(4)
    for _ in range(300):
        piece = [rng.choice((3, 4, 5)) for _ in range(rng.randint(1, 6))]
        state = 0
        for c in piece:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == ("".join(map(str, piece)) in joined)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [prose(rng, 40) for _ in range(6)] + ["short one", None, ""]
    edited = items[1].replace("w1", "v1", 2)
    texts = [
        prose(rng, 300), f"{prose(rng, 50)} {items[0].upper()} {prose(rng, 50)}", f"x {edited} y", items[2].replace(" ", " ,, "),
        items[3][: len(items[3]) // 2], None, "", "Short, one!", "a short one b", f"{items[4]} {items[5]}",
        "a short ones b", f"{items[0]} short one {items[1]}", "one short",
    ]
    table = docs_of(spark, texts).withColumn("ITEM_IDS", F.lit(1))
    got = {r["doc_id"]: r for r in decontaminate.find_items(table, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = []
        for k, item in enumerate(items):
            plain, body = decontaminate.normal(item), decontaminate.normal(text)
            if plain.count(" ") + 1 >= decontaminate.MIN_WORDS:
                best = decontaminate.brute_force(plain, body)
                if best <= int(len(plain) * decontaminate.EDIT_SHARE):
                    want.append((k, best))
            elif plain and f" {plain} " in f" {body} ":
                want.append((k, 0))
        assert [*zip(got[i]["item_ids"], got[i]["distances"], strict=True)] == want
    assert got[1]["item_ids"] == [0] and got[9]["item_ids"] == [4, 5] and got[8]["item_ids"] == [6]
    assert got[10]["item_ids"] == [] and got[11]["item_ids"] == [0, 1, 6] and got[12]["item_ids"] == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(table, none).where("size(item_ids) = 0").count() == len(texts)


def test_decontamination_of_a_very_long_text(spark):
    rng = random.Random(15)
    items = [prose(rng, 30), "tiny item"]
    body = f"{prose(rng, 100_000)} {items[0]} {prose(rng, 50_000)} tiny, item {prose(rng, 50_000)}"
    found = decontaminate.find_items(docs_of(spark, [body]), spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    assert [(r["item_ids"], r["distances"]) for r in found.collect()] == [([0, 1], [0, 0])]


def test_myers_distance_is_exact():
    rng = random.Random(6)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.Pattern(a).distance(b) == decontaminate.brute_force(a, b)


def test_page_text(spark):
    held_out = html_graph.labelled_pages(150, seed=1)
    model = html_graph.train(html_graph.labelled_pages())
    right = total = 0
    for page, marks in held_out:
        tree = html_graph.parse(page, {})
        texts = [" ".join("".join(s).split()) for _, s, _ in tree.runs]
        right += sum((p > 0.5) == m for p, m in zip(model.marginals(tree, texts), marks, strict=True))
        total += len(marks)
    assert right > 0.97 * total
    page = (
        "<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        "<div class='ad'>Buy this great thing now.</div><article><h1>A &amp; B</h1><p>First  one,\n<b>bold<p>Second &lt;x&gt;.</article>"
        "<div id='comments'><p>I liked this article very much.</p></div><footer>&copy; me</footer></body></html>"
    )
    pages = [page, None, "", "<<<", "<div" * 50, "<p>" * 2000]
    table = spark.createDataFrame([*enumerate(pages)], "page_id long, html string").withColumn("TEXT", F.lit(3))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_graph.extract_text(table, model).collect()}
    want = "A & B\n\nFirst one, bold\n\nSecond <x>."
    assert got[0] == (want, len(want)) and got[1] == ("", 0) and got[2] == ("", 0) and len(got) == 6


def test_page_text_with_implied_ends():
    def read(page):
        return [" ".join("".join(s).split()) for _, s, _ in html_graph.parse(page, {}).runs]

    start = "<html><head> <meta a=b><title>x</title><script>'<p>no'</script><template><p>no</template><noframes><p>no</noframes>\n"
    for end in ("<body>", "</head><body>", "<body></head>", "", "</title>"):
        assert read(start + end + "<article><p>One.</article>") == ["One."]
    assert read(start + "One.<p>Two.") == ["One.", "Two."]
    assert read("<p>a<svg><svg/><text>no</text></svg>b<svg><svg>no</svg>no</svg>c") == ["abc"]
    assert read("<p>a<button>no<button>no</button>b") == ["ab"]
    assert read("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <object data=f>this</object>") == ["if x=1 then this"]


def test_page_text_with_stray_quotes():
    def read(page):
        return [" ".join("".join(s).split()) for _, s, _ in html_graph.parse(page, {}).runs]

    assert read('<p title="5" tall">One.</p><p>Two.</p>') == ["One.", "Two."]
    assert read("<p title=it's>One.</p><p it's>Two.</p>") == ["One.", "Two."]
    assert read("""<p a="x>y" b='"' c = "'">One.</p>""") == ["One."]
    assert read('<p a="x>One.<p>Two.') == ["One.", "Two."]  # never closed
    assert read("<!-->One.<!-- <p>no --><p>Two.</ p>, three</>.<!-- no") == ["One.", "Two., three."]
    assert read("a < b <3 c") == ["a < b <3 c"]


@pytest.mark.parametrize("piece", ['<a b "', "<a b ", "<p a='", "<a b='\"", "</script ", "<!--", "<", "</", "<li><div>", "</p><div>"])
def test_long_broken_pages_take_linear_time(piece):
    import time

    def seconds(n):
        started = time.process_time()
        html_graph.parse("<script>x</script><p>One.</p>" + piece * n, {})
        return time.process_time() - started

    assert seconds(80_000) < 1 + 12 * seconds(20_000)  # sixteen times for quadratic work
    assert seconds(80_000) < 20


def test_page_text_of_an_empty_table_and_a_very_long_page(spark):
    model = html_graph.train(html_graph.labelled_pages(100))
    none = spark.createDataFrame([], "page_id long, html string")
    assert html_graph.extract_text(none, model).collect() == []
    blocks = [f"Sentence number {i} is here for you to read." for i in range(20_000)]
    page = "<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    long = spark.createDataFrame([(1, page)], "page_id long, html string")
    (row,) = html_graph.extract_text(long, model).collect()
    assert row["text"] == "\n\n".join(blocks)


def test_marginals_are_exact():
    """Sum-product against summing over all labellings."""
    import itertools

    model = html_graph.train(html_graph.labelled_pages(60))
    tree = html_graph.parse("<div>some words here.<p><a>l</a></p></div>", {})
    texts = [" ".join("".join(s).split()) for _, s, _ in tree.runs]
    runs = {node: i for i, (node, _, _) in enumerate(tree.runs)}
    owner = lambda n: tree.feature[tree.parent[n]][0]
    weight, total = np.zeros(len(texts)), 0.0
    for labels in itertools.product(*[range(2 if n in runs else 3) for n in range(len(tree.parent))]):
        w = 1.0
        for n, s in enumerate(labels):
            run = n in runs
            feature = html_graph.run_features(owner(n), texts[runs[n]], tree.runs[runs[n]][2]) if run else tree.feature[n]
            w *= model.potential(feature, run)[s]
            if n:
                w *= (model.pair_run if run else model.pair)[labels[tree.parent[n]]][s]
        total += w
        for n, i in runs.items():
            weight[i] += w * labels[n]
    assert np.allclose(model.marginals(tree, texts), weight / total)


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return [(i, len(s), p) for i, (s, p) in enumerate(zip(sets, part, strict=True))]


@pytest.mark.parametrize(("words", "percent", "group"), [(3, 90, 1024), (5, 80, 4)])
def test_ngram_join(spark, monkeypatch, words, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)  # 4: also by way of the middle row
    monkeypatch.setattr(ngram_join, "SIFTED", group)  # 4: also in bands and pieces
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 8, 30, 60, 120, 400)]
    texts = [None, "", " \n", "one", "ONE", "one two", "é É", *base]
    for b in base:
        for _ in range(9):
            w = b.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [base[3], base[3].upper(), prose(rng, 5000)]
    got = ngram_join.similarity_classes(docs_of(spark, texts).withColumn("key", F.lit(0)), words, percent)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, words, percent)


def test_bucket_counts_part_no_linked_rows():
    rng = np.random.default_rng(5)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    rows, passage = [], some(200)
    for n in (1, 2, 3, 40, 64, 65, 300, 9_000):
        base = some(n)
        for share in (0, 0.05, 0.12, 0.5):
            changed = int(n * share)
            rows.append(np.unique(np.concatenate([base[changed:], some(changed)])))
    rows += [np.unique(np.concatenate([passage, some(n)])) for n in (20, 200, 210, 220)]
    rows.sort(key=len)
    sizes = np.array([len(r) for r in rows])
    part = ngram_join.bound_parts(sizes, [ngram_join.bucket_counts(r) for r in rows], [np.array([1])] * len(rows), 80)
    apart = 0
    for i, a in enumerate(rows):
        for j in range(i):
            both = len(np.intersect1d(a, rows[j]))
            linked = 100 * both >= 80 * (len(a) + len(rows[j]) - both)
            assert not linked or part[i] == part[j]
            apart += both > 0 and part[i] != part[j]
    assert apart > 10  # rows that share a passage only fall apart


def test_ngram_join_without_ids_or_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "x y z"), (7, "q r s"), (7, "q r s")]
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, DOCS), 3, 90).collect()
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in got) == [(1, -1), (1, 7), (1, 7), (2, 5), (2, 5)]
    assert ngram_join.similarity_classes(docs_of(spark, ["x"]).limit(0), 3, 90).count() == 0


def test_ngram_join_around_a_row_without_id(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 4)  # by way of the middle row
    rng = random.Random(11)
    base = prose(rng, 200).split()
    rows = [(None, " ".join(base))]  # meets most of the others
    for i in range(12):
        w = list(base)
        w[15 * i + 8] = f"z{i}"
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(table, 3, 90).collect()}
    assert got == {i: 0 for i in range(12)} | {None: None}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    part = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                part[a] = part[b] = min(part[a], part[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == part


def brute_repeats(texts, length):
    seen = {}
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone[:-1].astype(int), prepend=0) == 1).sum()) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("local", "together", "batches"), [(1024, 2048, 2), (1, 16, 3), (1024, 4, 1)])
def test_suffix_index(spark, monkeypatch, local, together, batches):
    monkeypatch.setattr(suffix_index, "LOCAL", local)  # 1: by rounds of names only
    monkeypatch.setattr(suffix_index, "TOGETHER", together)
    monkeypatch.setattr(suffix_index, "SORTED", 5)
    rng = random.Random(9)
    length, seed = 60, 20
    common = [prose(rng, n) for n in (12, 16, 40, 200)]
    texts = [None, "", "short", "é" * 400, "ab" * 300, common[3], common[3]]
    for _ in range(40):
        parts = [prose(rng, rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(common)
            a = rng.randrange(len(piece) // 2)
            parts += [piece[a : a + rng.randint(40, 500)], prose(rng, rng.randint(1, 10))]
        texts.append(" ".join(parts))
    texts += [texts[-1][:200] + "!" + texts[-1][200:], "x" + common[2], "y" + common[2] + "z"]
    table = docs_of(spark, texts).repartition(3)
    cuts = suffix_index.repeats(table, whole_text(), length, seed, batches)
    keyed = table.select("doc_id", "text", suffix_index.text_key(whole_text()).alias("key")).join(cuts, "key", "left")
    got = {}
    for r in suffix_index.cut_spans(keyed, whole_text(), ["doc_id", "text"]).collect():
        kept = (r["text"] or "").encode() if r["kept"] is None else bytes(r["kept"])
        got[r["doc_id"]] = (r["n_removed"], r["n_spans"], hashlib.sha256(kept).hexdigest())
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_removed_repeats_leave_text(spark):
    text = "prose é " * 3 + "é" * 401
    table = docs_of(spark, [text, "x" + text, None, "kept"]).withColumn("kept", F.lit("own")).withColumn("key", F.lit(1))
    got = sorted(suffix_index.remove_repeats(table).collect())
    assert [tuple(r) for r in got] == [(0, "", "own", 1), (1, "x", "own", 1), (2, None, "own", 1), (3, "kept", "own", 1)]
    assert suffix_index.remove_repeats(table.limit(0)).count() == 0


def test_suffix_dedup_query_at_400_bytes(spark, tmp_path):
    rng = random.Random(21)
    sizes = (310, 399, 400, 401, 560)  # more than fifty words each
    passages = [prose(rng, 200)[:n].replace(" w", " ") for n in (400, 520, 560, 600, 800)]
    passages = [p[:n] for p, n in zip(passages, sizes, strict=True)]
    assert [len(p) for p in passages] == list(sizes) and all(len(p.split()) > 50 for p in passages)
    texts = [None, ""]
    for p in passages:  # nothing but the passage is shared by its two documents
        texts += [f"{prose(rng, 60)} <{p}> {prose(rng, 60)}", f"{prose(rng, 60)} ({p}) {prose(rng, 60)}"]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    got = [(rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) for i in range(len(texts))]
    assert got == brute_repeats(texts, 400)
    assert [g[0] for g in got] == [0, 0, 0, 0, 0, 0, 400, 400, 401, 401, 560, 560]
    assert [rows[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]


def test_nearest_by_codes(spark):
    rng = np.random.default_rng(11)
    points = rng.standard_normal((900, 24)) + rng.standard_normal(24)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [1.0]), (None, points[0].tolist())]
    rows += [(1005, points[3].tolist())]  # ties with 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in rotated_codes.nearest(table, "vec_id", "embedding", F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids = np.append(np.arange(900), 1005)
    values = np.vstack([points, points[3]])
    assert got.keys() == set(range(0, 900, 20))
    hits = 0
    for q, ranks in got.items():
        scores = values @ points[q]
        scores[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]].tolist()
        hits += len({v for v, _ in ranks.values()} & set(want))
        assert sorted(ranks) == list(range(1, 21))
        assert all(abs(s - points[q] @ values[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, s in ranks.values())
    assert hits >= 0.98 * 20 * len(got)
    few = rotated_codes.nearest(table.where("vec_id in (0, 3, 1005)"), "vec_id", "embedding", F.col("id") % 20 == 0, 20)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()][-2:] in ([(1, 3), (2, 1005)],)
    assert rotated_codes.nearest(table.limit(0), "vec_id", "embedding", F.col("id") % 20 == 0, 20).count() == 0


def test_shards_come_from_one_pass_in_python(spark, monkeypatch):
    plans = []
    keep = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    rows = spark.createDataFrame([(i if i % 7 else None,) for i in range(100)], "doc_id long")
    got = sharding.assign(rows, "doc_id", 8).collect()
    assert sum(plans[0].count(node) for node in ("ArrowEvalPython", "MapInArrow")) == 1
    keys = np.array([r["doc_id"] or 0 for r in got], np.uint64)
    assert [r["shard"] for r in got] == sharding.jump_hash(keys, 8).tolist()
    assert [r["grown_shard"] for r in got] == sharding.jump_hash(keys, 9).tolist()


def test_rows_leave_out_their_lightest_blocks():
    rng = np.random.default_rng(5)
    for n, percent in ((480, 80), (1500, 80), (300, 90)):
        row = rng.integers(0, 2**63, n, dtype=np.uint64)
        keys = ngram_join.block_keys(row, percent)
        gone = n * (100 - percent) // (100 + percent)  # as many columns as a linked row of the same size may lack
        other = np.append(row[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64))
        assert len(np.intersect1d(keys, ngram_join.block_keys(other, percent)))
        # Rows without a common column meet in blocks that have none, if anywhere.
        strangers = [ngram_join.block_keys(rng.integers(0, 2**63, n, dtype=np.uint64), percent) for _ in range(40)]
        assert sum(len(np.intersect1d(keys, k)) for k in strangers) <= 10


def test_last_merge_keeps_no_array(spark, monkeypatch):
    labels, keep = [], suffix_index.stored
    monkeypatch.setattr(suffix_index, "stored", lambda df, label: labels.append(label) or keep(df, label))
    same = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = docs_of(spark, [f"{i} " * 60 + same + f" {i}" * 60 for i in range(6)])
    cuts = suffix_index.repeats(rows, F.col("text"), 200, 64, 2)
    assert cuts.count() == 6
    assert labels.count("suffixes") == 2  # one for each batch


def test_keys_go_in_passes_and_texts_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    labels, keep, joins, join = [], ngram_join.stored, [], ngram_join.with_grams
    monkeypatch.setattr(ngram_join, "stored", lambda df, label: labels.append(label) or keep(df, label))
    monkeypatch.setattr(ngram_join, "with_grams", lambda *args: joins.append(args) or join(*args))
    rng = random.Random(12)
    texts = []
    for copies in (12, 3):  # a group above GROUP rows and one below
        base = prose(rng, 200).split()
        for i in range(copies):
            texts.append(" ".join(base[: 13 * i] + [f"z{i}"] + base[13 * i + 1 :]))
    got = ngram_join.similarity_classes(docs_of(spark, texts), 3, 90).collect()
    assert sorted(map(tuple, got)) == brute_components(texts, 3, 90)
    assert labels.count("meeting") == ngram_join.PASSES > 1
    assert len(joins) == 1


def test_passes_deal_every_key_once(spark):
    rows = spark.createDataFrame([(i, [k * 7 - 50 for k in range(20) if i % 3 or k % 2]) for i in range(6)], "id_row long, keys array<long>")
    parts = [{r["key"] for r in ngram_join.meeting_rows(rows, turn).collect()} for turn in range(ngram_join.PASSES)]
    assert sorted(k for part in parts for k in part) == [k * 7 - 50 for k in range(20)]
