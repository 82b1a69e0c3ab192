import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.llm import addresses, groups, lookalikes, mixing, name_parts, names, personal, queries, scan_noise, tokens
from docsift.llm.common import _in_blocks, _rows, cells, classes_within, pairs_within
from docsift.session import cut, numbered

TOWNS = "city_name string, state_code string, country_name string, code_prefix string, code_length int"


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_pairs_within_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("kkkab"), i, rng.choice("xy")) for i in range(60)] + [(None, 99, "x"), ("k", 100, None)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "key string, id bigint, var string")
    got = pairs_within(df, "key", "id", "var", "l", "r", block=7).collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and a[2] != b[2]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert pairs_within(df.limit(0), "key", "id", "var", "l", "r").count() == 0


@pytest.mark.parametrize("hot", [groups.HOT, 3])
def test_groups_against_union_find(spark, hot):
    rng = random.Random(hot)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 560)] + [(900, 900)]
    pairs += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rows = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs] + pairs[:9] + [(None, 3), (4, None)]
    df = spark.createDataFrame([(a, b, "extra") for a, b in rows], "left_ix bigint, right_ix bigint, group_ix string")
    got = groups.connected_groups(df, "left_ix", "right_ix", hot=hot).collect()
    assert dict((r[0], r[1]) for r in got) == union_find(pairs) and len(got) == len(union_find(pairs))


def test_a_class_of_many_rows_stays_in_bounded_cells(spark):
    n, block = 100_000, 4_000
    df = spark.range(n).select(F.lit("k").alias("k"), "id", F.when(F.col("id") < 30_000, "one").when(F.col("id") < 60_000, F.col("id").cast("string")).otherwise("other").alias("v"))
    rows, _ = _rows(df, "k", "id", "v")
    for side in cells(_in_blocks(rows, n, block, 1_000)):
        assert side.groupBy("x", "y").count().agg(F.max("count")).first()[0] < 1.2 * block
    few = df.withColumn("v", F.when(F.col("id") < 3, F.col("id").cast("string")).otherwise("same"))
    assert pairs_within(few, "k", "id", "v", "l", "r").count() == 3 * (n - 3) + 3
    got = classes_within(few, "k", "id", "v", hot=1_000).groupBy("class_id", "links").count().collect()
    assert {tuple(r) for r in got} == {(0, n - 1, 3), (0, 3, n - 3)}


def test_pairs_of_large_variants_against_brute_force(spark):
    rows = [("k", i, "abcdefgh"[min(7, i // 70)] if i < 300 else str(i % 90)) for i in range(420)]
    df = spark.createDataFrame(rows, "k string, id bigint, v string")
    got = pairs_within(df, "k", "id", "v", "l", "r", block=25, hot=50).collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] != b[2]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_groups_of_a_star_and_a_chain_without_the_tail(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000 + i, 2000 + (i * 7) % 300) for i in range(300)]
    df = spark.createDataFrame(pairs, "left_ix bigint, right_ix bigint")
    for hot, tail in ((20, 0), (groups.HOT, 0), (20, 100)):
        assert dict(map(tuple, groups.connected_groups(df, "left_ix", "right_ix", hot=hot, tail=tail).collect())) == union_find(pairs)


def test_groups_of_nothing_and_rejected(spark):
    df = spark.createDataFrame([(1, 2, False), (3, 4, None), (5, None, True)], "left_ix bigint, right_ix bigint, is_match boolean")
    assert groups.match_groups(df).count() == 0


BPE = tokens.encoder(tokens.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=["'", "s", "l", "r", "e", " ", "\n", "\t", "a", "1", "é", "я", ".", "😀", "v"], max_size=60), st.integers(1, 9))
def test_tree_encoding_is_exact(text, leaf):
    ids = BPE.encode(text, leaf)
    assert ids == BPE.bpe.encode_ordinary(text) and BPE.decode(ids, 3) == text


def test_ordinary_texts_have_joins(monkeypatch):
    joins = []
    plain = tokens.ByteBpe.join
    monkeypatch.setattr(tokens.ByteBpe, "join", lambda self, *a: joins.append(1) or plain(self, *a))
    text = "The carrier returned 54 cartons because the note was previous. " * 14
    assert BPE.encode(text) == BPE.bpe.encode_ordinary(text) and len(joins) >= 3


def test_encoding_of_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "don't  stop"), (3, "don't  stop"), (4, "word " * 30_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_column(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and got[3] == BPE.bpe.encode_ordinary("don't  stop") and got[4] == BPE.bpe.encode_ordinary("word " * 30_000)
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_mixture(spark):
    docs = [(i, "abc"[i % 3] if i < 270 else "a", f"word number {i} " * (1 + i % 7)) for i in range(400)] + [(900, "a", None), (901, "b", ""), (902, None, "x"), (903, "z", "no target")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.25, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix_documents(df, targets)
    rows = mixed.collect()
    assert max(Counter(r["doc_id"] for r in rows if r["source"] == "a").values()) == 1 and all(r["copy_no"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in rows)
    got = {r["source"]: r for r in shares.collect()}
    assert all(abs(got[s]["actual_share"] - t / 0.95) < 0.02 for s, t in (("a", 0.4), ("b", 0.3), ("c", 0.25)))
    assert got["absent"]["mixed_tokens"] == got["z"]["mixed_tokens"] == got[None]["mixed_tokens"] == 0
    again = mixing.mixture(mixing.sized_documents(df.repartition(3)), mixing.plan(mixing.sized_documents(df), targets)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    empty, none = mixing.mix_documents(df.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4


def test_look_alikes(spark):
    same = ["Café Total: 5", "Café Total: 5", "Ｃafé Tоtal: 5", "Caf​é Total꞉ 5"]
    other = ["Cafe Total: 5", "café Total: 5", "Café Total: 6", "Café\nTotal: 5", "Договор", "Договоp", "", None]
    df = spark.createDataFrame(list(enumerate(same + other + same[:1])), "doc_id bigint, text string")
    got = {tuple(r) for r in lookalikes.same_looking_pairs(df).collect()}
    n = len(same + other)
    want = {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(8, 9)} | {(a, n) for a in range(1, 4)}
    assert got == want
    classes = {r["doc_id"]: (r["class_id"], r["links"]) for r in lookalikes.same_looking_classes(df).collect()}
    assert classes[0] == (0, 3) and classes[n] == (0, 3) and classes[1] == (0, 4) and classes[8] == (8, 1) and classes[4] == (4, 0) and 10 not in classes and 11 not in classes
    forms = {r["doc_id"]: r["form"] for r in lookalikes.consistent_form(df, "doc_id", "text").collect()}
    assert forms[9] == "Договор" and forms[2] == same[0] and forms[10] == "" and forms[11] is None


def test_compatibility_forms(spark):
    texts = ["ｶﾞ ｱ Ⅳ … ﬁ a-b ½", "ガ ア IV ... fi a‑b ½", "ガ ア IV ... fi a-b 1/2", "x² ſ", "x2 s", "a  b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {tuple(r) for r in lookalikes.same_looking_pairs(df).collect()} == {(0, 1)}


def test_addresses(spark):
    towns = spark.createDataFrame([("Harwick", "HW", "Keth", "110", 5), ("Lorneport", "LP", "Vorland", "127", 6)], TOWNS)
    a = ["12 Yeltiford Street, Harwick 11045", "yeltifrod str. no 12; 11045 harwick", "HARWICK 11045, 12 YELTIFORD ST, near Bus Stand", "Unit 3, 12 Yeltiford Street, Harwick 11045", "3/12 Yeltiford St Harwick",
         "13 Yeltiford Street, Harwick 11045", "12 Yeltiford Street, Lorneport 127111", "12 Yeltiford Road, Harwick 11045", "12 Yeltiford St, 11045", None, "", "no address at all", "12 Yeltiford Street, Harwick 11045"]
    df = spark.createDataFrame([(i, (x,)) for i, x in enumerate(a)], "doc_ix bigint, doc_fields struct<address: string>")
    got = {tuple(r) for r in addresses.same_place_pairs(df, towns).collect()}
    place = [0, 1, 2, 8, 12]
    assert got == {(x, y) for x in place for y in place if x < y and a[x] != a[y]} | {(3, 4)}
    assert addresses.same_place_pairs(df.limit(0), towns).count() == 0


RECORDS = "rec bigint, unit string, house string, street string, kind string, town string, code string"


def test_addresses_without_kind_or_number(spark):
    towns = spark.createDataFrame([("Harwick", "HW", "Keth", "110", 5), ("Carrowick", "CK", "Keth", "263", 6)], TOWNS)
    a = ["12 Broadway, Harwick 11045", "12 BROADWAY Harwick 11045", "Hauptstrasse 12, Harwick 11045", "HAUPTSTRASSE 12, HARWICK 11045", "14 Broadway, Harwick 11045", "Carrowick 263 189 Belfiford Cres No 296 Keth",
         "296 Belfiford Crescent, Carrowick 263189", "The Old Mill, Harwick", "THE OLD MILL HARWICK", "12 Broadway Street, Harwick", "-- 12"]
    df = spark.createDataFrame([(i, (x,), "clash") for i, x in enumerate(a)], "doc_ix bigint, doc_fields struct<address: string>, text string")
    got = {tuple(r) for r in addresses.same_place_pairs(df, towns).collect()}
    assert got == {(0, 1), (2, 3), (5, 6), (7, 8)}
    classes = {r["doc_ix"]: (r["class_id"], r["links"]) for r in addresses.same_place_classes(df, towns).collect()}
    assert classes == {i: (c, n) for i, c, n in [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 2, 1), (4, 4, 0), (5, 5, 1), (6, 5, 1), (7, 7, 1), (8, 7, 1), (9, 9, 0)]}


def test_neighbourhood_blocks_lose_no_pair(spark):
    recs = [(i, "", str(i // 3), "abcdefghi" + "xyz"[i % 3], "street", "harwick", "") for i in range(90)]
    df = spark.createDataFrame(recs, RECORDS).repartition(5)
    placed = numbered(df, ["town", "house", "street"], "pos")
    got = {tuple(sorted(r)) for r in addresses.neighbourhood_pass(placed, window=4, block=8).collect()}
    assert got == {(3 * k + i, 3 * k + j) for k in range(30) for i in range(3) for j in range(i + 1, 3)}


def test_blocks_larger_than_the_window_lose_no_pair(spark):
    rng = random.Random(4)
    base = ["yeltiford", "quarlemont", "brindleham"]
    streets = sorted({"".join(rng.choice("abxyz") if rng.random() < 0.12 else c for c in rng.choice(base)) for _ in range(200)})
    recs = [(i, "", "7", w, "street", "harwick" if i % 5 else "", "11045") for i, w in enumerate(streets)] + [(900, "", "8", "yeltiford", "street", "harwick", "")]
    df = spark.createDataFrame(recs, RECORDS)
    got = {tuple(sorted(r)) for r in addresses.beyond_windows(df, len(recs), window=2, block=20).collect()}
    want = {(x[0], y[0]) for x in recs for y in recs if x[0] < y[0] and addresses.same_place(x[1:], y[1:])}
    assert got == want and len(want) > 100


def test_edit_distances():
    assert addresses.edits("kirk", "krik") == 1 and addresses.edits("a", "abcdef") == 3
    assert name_parts.distance("ca", "abc") == 2 and name_parts.distance("kirk", "krik") == 1 and name_parts.distance("", "ab") == 2


def test_radius_join_against_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))) for _ in range(160)})
    df = spark.createDataFrame([(str(i), "s" if i % 2 else "t", w) for i, w in enumerate(words)], "rec string, sector string, core string")
    for radius in (1, 2):
        got = {tuple(sorted(map(int, r))) for r in names.radius_pairs(df, radius, cell=12).collect()}
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if i % 2 == j % 2 and name_parts.distance(words[i], words[j]) <= radius}
        assert got == want


def test_radius_join_moves_few_rows_for_a_word_of_a_large_sector(spark):
    def moved():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 7))) for _ in range(1_500)})
    words += [words[0][:3] + c + words[0][3:] for c in "klmnopqrstuv"]  # one cell of many words
    df = spark.createDataFrame([(str(i), "s", w) for i, w in enumerate(words)], "rec string, sector string, core string")
    before = moved()
    got = {tuple(sorted(map(int, r))) for r in names.radius_pairs(df, 1, cell=5).collect()}
    after = moved()
    met = {}
    for i, w in enumerate(words):
        for v in name_parts.variants(w, 1):
            met.setdefault(v, set()).add(i)
    want = {(i, j) for m in met.values() for i in m for j in m if i < j and name_parts.distance(words[i], words[j]) <= 1}
    assert got == want and len(want) > 70
    assert sum(n for k, n in after.items() if k not in before) < 12 * len(words)


def test_names(spark):
    a = ["Gresbilock Chemical Industries Ltd", "gresbiloock chem. inds", "Chem. Inds, Gresbilock Limited", "GresbilockChemicalIndustries", "Gresbilock Steel Fabricators Ltd",
         "Elizabeth Haneura", "Haneura, Lizzie", "E. Haneura", "HANEURA Elizabeth", "Mr. elizabeth haneura - sole trader", "Edward Norbank", "Eleanor Norbank", "E. Norbank", None, "", "--"]
    df = spark.createDataFrame([(i, (x,)) for i, x in enumerate(a)], "doc_ix bigint, doc_fields struct<company_name: string>")
    got = {tuple(r) for r in names.same_name_pairs(df).collect()}
    assert got == {(x, y) for g in ((0, 1, 2, 3), (5, 6, 7, 8, 9)) for x in g for y in g if x < y}
    assert names.same_name_pairs(df.limit(0)).count() == 0
    classes = {r["doc_ix"]: (r["class_id"], r["links"]) for r in names.same_name_entities(df).collect()}
    assert all(classes[x] == (0, 3) for x in range(4)) and all(classes[x] == (5, 4) for x in range(5, 10)) and classes[4] == (4, 0) and set(classes) == set(range(13))


def test_lexicon_against_all_words():
    for word in ("chemcal", "enginering", "machinary", "elizabth", "lizabeth", "xyzzy", "textlies"):
        for lexicon, words, most in ((name_parts._TYPED, name_parts.TYPED, 2), (name_parts._LONG, name_parts.LONG, 1), (name_parts._GIVENS, name_parts.GIVENS, 1)):
            assert lexicon.near(word, most) == {w for w in words if name_parts.distance(word, w) <= most}


def test_names_one_typing_error_apart_as_typed(spark):
    a = ["Thorgotor Chemical Industries Co", "thorgtoor chem. inds co.", "LAMSERATH ENGINEERING WORKS CO", "Lamseeath Engineering Works", "Frances Ormgoimbe", "Frances Sven Ormgoombe",
         "Ketteroon Steel Fabricators", "Keteroun Steel Fabricators"]
    df = spark.createDataFrame([(i, (x,)) for i, x in enumerate(a)], "doc_ix bigint, doc_fields struct<company_name: string>")
    got = {tuple(r) for r in names.same_name_pairs(df).collect()}
    assert got == {(0, 1), (2, 3), (4, 5)}


def test_short_forms_of_names_with_different_initials(spark):
    a = ["Kate Kurkelli", "Kurkelli, Kate", "KATE KURKELI", "Ned Kurkelli", "Ted Norquist", "Mr. Teddy Norquist", "Eddie Halbrook", "Ted Halbrook", "Theodore Marsten", "Marsten, Ted", "Nell Varsen"]
    df = spark.createDataFrame([(i, (x,)) for i, x in enumerate(a)], "doc_ix bigint, doc_fields struct<company_name: string>")
    assert {r["text"] for r in names.entities(df.select("doc_fields.company_name").toDF("text")).collect()} == set(a)
    got = {tuple(r) for r in names.same_name_pairs(df).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (4, 5), (6, 7), (8, 9)}


def test_personal(spark):
    t = ("Anthony Dane Verbooff - sole trader\n12 Yeltiford Street, Harwick 11045\nTAX INVOICE\nTransaction ID: B0000180\nDear Rebecca, Mobile +44 20 7946 0294 (evenings). Part no. 884-392-4270 replaces it.\n"
         "Resident of Flat 3, 9 Norfirth Rd., Harwick 11046. Social security 666-87-7546 appears on the form. Copies went to ann_b3 (at) mail.example and to us.\n"
         "According to Mr. Kirbius the carton was open. Copy to Jorrepole Textile Mills. Signed by Melmaani, Elizabeth.\nConsignment 6936 8144 3425 left.")  # fmt: skip
    df = spark.createDataFrame([(1, "text", t), (1, "text", t), (2, "ocr", t), (3, "text", None), (4, "text", "")], "doc_ix bigint, source string, text string")
    got = {(r["pii_type"], r["pii_text"]) for r in personal.find_personal(df).collect()}
    assert got == {
        ("person_name", "Anthony Dane Verbooff"), ("street_address", "12 Yeltiford Street, Harwick 11045"), ("person_name", "Rebecca"), ("phone", "+44 20 7946 0294"),
        ("street_address", "Flat 3, 9 Norfirth Rd., Harwick 11046"), ("id_number", "666-87-7546"), ("email", "ann_b3 (at) mail.example"), ("person_name", "Kirbius"), ("person_name", "Melmaani, Elizabeth"),
    }
    clean = {r["doc_ix"]: r["text"] for r in personal.redacted_texts(df).collect()}
    assert "[NAME]" in clean[1] and "666-87" not in clean[1] and "Part no. 884-392-4270" in clean[1] and clean[3] is None and clean[4] == ""
    assert personal.find_personal(df.limit(0)).count() == 0


def test_checksums():
    assert personal.luhn("4539578763621486") and not personal.luhn("4539578763621487")
    assert personal.mod97("GB82 WEST 1234 5698 7654 32") and not personal.mod97("GB83 WEST 1234 5698 7654 32")
    assert personal.verhoeff("2363") and not personal.verhoeff("2364")


def test_scan_noise(spark):
    clean = "The warranty for rubber gaskets begins with the installation and ends after ninety months\nunder the pre-agreed terms the supplier keeps units available at all times for the carrier"
    page = ["Acme Ltd | Terms of supply", "Acme Ltd", "TAX INVOICE", "", "the warrant-", "y for rubbcr gaskets begins with the pre-", "p. 1", "", "Acme Ltd | Terms of supply", "agreed terms for the c@rricr", "p. 2"]
    rows = [(i, "text", clean) for i in range(8)] + [(50, "ocr", "\n".join(page))] * 2 + [(51, "ocr", None), (52, "ocr", " \n"), (53, "ocr", "")]
    df = spark.createDataFrame(rows, "doc_ix bigint, source string, text string")
    got = {tuple(r) for r in scan_noise.scan_defects(df).collect()}
    assert got == {(50, 1, "header"), (50, 9, "header"), (50, 7, "page_number"), (50, 11, "page_number"), (50, 5, "hyphen"), (50, 6, "misread"), (50, 10, "misread")}
    text = {r["doc_ix"]: r["text"] for r in scan_noise.repaired_texts(df).collect()}[50]
    assert "the warranty for rubber gaskets begins with the pre-agreed terms for the carrier" in text and "Terms of supply" not in text
    assert scan_noise.scan_defects(df.limit(0)).count() == 0


def test_headers_are_compared_whole():
    a, b = "Acme Works of Northern Harbours and Inland Waterways Limited, Department of Long Distance Haulage, first", "Acme Works of Northern Harbours and Inland Waterways Limited, Department of Long Distance Haulage, other one"
    assert not scan_noise._near(a, b) and scan_noise._near(a, a.replace("Works", "W0rks"))
    page = [a + " | Terms of supply", "Acme Ltd", "TAX INVOICE", "", "the carrier", "", a + " | Terms of supply", "prose"]
    assert {0: "header", 6: "header"}.items() <= scan_noise.furniture(page).items()


def test_headers_of_even_pages():
    prose = ["the carrier returned 2", "Acme Works settled 948 cartons", ""]
    page = ["Acme Works Ltd - Terms of supply 1", "Acme Works Ltd", "TAX INVOICE", "", *prose, "2 Acme Works Ltd", *prose, "Acme Works Ltd - Terms of supply 3", *prose, "Acrne Works Ltd 4", *prose]
    assert scan_noise.furniture(page) == {0: "header", 7: "header", 11: "header", 15: "header"}
    page = ["Kelgate file | Ledger notes", "Acme Works Ltd", "TAX INVOICE", "", *prose, "54 Kelgate file", *prose, "Kelgate file", *prose[:2], "Kelgate file", "Pg 56"]
    assert scan_noise.furniture(page) == {0: "header", 7: "header", 11: "header", 14: "header", 15: "page_number"}


def test_editor_on_held_out_words():
    words = {w: 400 for w in "warranty rubber gaskets begins installation months supplier carrier available cartons pallets notice delivery certified terms company period branch quantity invoice".split()}
    cases = []
    rng = random.Random(2)
    for w in words:
        m = scan_noise._misread(w, rng)
        cases += [(w, None)] + ([(m[0], (m[3], m[1], m[2]))] if m else [])
    make = lambda w: [c for c in scan_noise.candidates(w) if words.get(c[3], 0) > words.get(w, 0)]
    examples = []
    for w, gold in cases:
        options = make(w)
        if options and (gold is None or any(c[:3] == gold for c in options)):
            examples.append(([scan_noise.features(w, [(a, s, t)], words.get(w, 0), words[e], words.get(w, 0)) for a, s, t, e in options], -1 if gold is None else next(k for k, c in enumerate(options) if c[:3] == gold)))
    half = len(examples) // 2
    model = scan_noise.Perceptron()
    model.w = model.train(examples[:half], 5)
    assert sum(model.best(o) == g for o, g in examples[half:]) >= 0.9 * (len(examples) - half)


def test_queries_are_registered():
    assert {f"p{n}_" for n in (1, 3, 4, 5, 6, 7, 8, 9)} == {q[:3] for q in queries.queries()}


def test_a_written_step_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    counted = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    before = files()
    assert cut(counted).agg(F.sum("count")).first()[0] == 1_000
    end = time.time() + 10  # they are removed in the background
    steps = lambda: {name.split("_")[1] for name in files() - before}
    while len(steps()) > 1 and time.time() < end:
        time.sleep(0.2)
    assert len(steps()) <= 1  # only that of the sum, which is not cut
