"""The ten problems on small fixtures: brute force, round trips, invariants, and what is defined for odd input."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from linkloom.llm import addresses, bpe, cutoff, encoding, lookalike, matching, names, neighbours, packing, pairs, plain, scores, stuffing, topn

SCORED = "s1_id string, cand_id string, prob double, scored_at timestamp_ntz, extra string"
RECORDS = "entity_id string, source_tag string, business_name string, business_address string, country string, value string"


def at(day):
    import datetime

    return datetime.datetime(2026, 1, day)


# scores, cutoffs, top n --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        s1 = "S1-1" if rng.random() < 0.35 else f"S1-{rng.randint(2, 40)}"
        rows.append((s1, f"S{rng.randint(2, 3)}-{rng.randint(1, 120)}", rng.choice([0.1, 0.5, 0.5, round(rng.random(), 6), None, float("nan")]), at(rng.randint(1, 28)), "x"))
    rows += rows[:30] + [(None, "S2-1", 0.9, at(1), "x"), ("S1-2", None, 0.9, at(1), "x"), ("S1-3", "S2-9", 0.7, None, "x")]
    return spark.createDataFrame(rows, SCORED)


def latest(rows):
    best = {}
    for r in rows:
        if r.s1_id is None or r.cand_id is None or r.prob is None or r.prob != r.prob:
            continue
        key = ((r.scored_at is not None, r.scored_at), r.prob)
        if (r.s1_id, r.cand_id) not in best or key > best[r.s1_id, r.cand_id]:
            best[r.s1_id, r.cand_id] = key
    return {k: v[1] for k, v in best.items()}


def test_counting_pairs(scored):
    got = {(r.s1_id, r.cand_id): r.prob for r in scores.counting_pairs(scored).collect()}
    assert got == latest(scored.collect())
    assert scores.counting_pairs(scored.limit(0)).count() == 0


def test_cutoffs(spark, scored):
    rng = random.Random(2)
    rec = [(f"S{s}-{i}", f"S{s}", "n", "a", rng.choice(["US", "US", "India", "", None]), "v") for s in (2, 3) for i in range(1, 121)]
    records = spark.createDataFrame(rec + rec[:9], RECORDS)
    targets = [(s, c, k) for s in ("S2", "S3") for c, k in (("US", 250), ("India", 1000), ("Mars", 500))] + [("S2", None, 1)]
    got = {tuple(r) for r in cutoff.keep_share_cutoffs(scored, records, spark.createDataFrame(targets, "source_tag string, country string, keep_permille int")).collect()}
    best = {}
    for (_, c), p in latest(scored.collect()).items():
        best[c] = max(p, best.get(c, -1))
    want = set()
    for s, c, k in targets:
        v = sorted((round(best[r[0]] * 1e6) for r in set(rec) if r[1] == s and r[4] == c and c and r[0] in best), reverse=True)
        if v:
            cut = next(x for x in v if sum(y >= x for y in v) * 1000 >= k * len(v))
            want.add((s, c, cut, sum(y >= cut for y in v)))
    assert got == want and len(want) == 4
    assert cutoff.keep_share_cutoffs(scored.limit(0), records, spark.createDataFrame(targets, "source_tag string, country string, keep_permille int")).count() == 0


def test_top_n(scored):
    got = {(r.s1_id, r.cand_id) for r in topn.top_per_group(scores.counting_pairs(scored)).collect()}
    by = {}
    for (s, c), p in latest(scored.collect()).items():
        by.setdefault(s, []).append((-p, c))
    assert got == {(s, c) for s, x in by.items() for _, c in sorted(x)[:10]}
    assert topn.top_per_group(scores.counting_pairs(scored.limit(0))).count() == 0


# names, addresses, look-alikes -------------------------------------------------------------------------------------------


def records_of(spark, rows):
    return spark.createDataFrame([(i, i[:2], n, a, c, "extra") for i, n, a, c in rows], RECORDS)


def linked(df):
    return {tuple(r) for r in df.select("id_a", "id_b").collect()}


NAMES = [
    ("S1-1", "Royal Kemosudo & Crarisi Bakery Ltd", "x", "US"), ("S2-1", "Crarisi Kemosudo Bkry", "x", "US"), ("S2-2", "ROYAL KEMOSUDO CRARISI", "x", "US"), ("S3-1", "Kemosdo Crarisi Bakery", "x", "US"),
    ("S3-2", "Kemosudo Crarisi Motors", "x", "US"), ("S3-3", "Star Kemosudo Crarisi Bakery", "x", "US"), ("S1-2", "Zebulon D. Trulahoso Photography", "x", "US"), ("S2-3", "Trulahoso, Zeb Photo", "x", "US"), ("S2-4", "Z. Trulahoso Photography", "x", "US"),
    ("S2-5", "Robert Trulahoso Photography", "x", "US"), ("S1-3", "null", "x", "US"), ("S2-6", "N/A", "x", "US"), ("S2-7", None, "x", "US"), ("S2-8", "", "x", "US"), ("S3-9", "Spikife House f/k/a Kemosudo Crarisi Bakery", "x", "US"), ("S3-9", "Spikife House f/k/a Kemosudo Crarisi Bakery", "x", "US"),
]


def test_names(spark):
    got = linked(names.spelling_pairs(records_of(spark, NAMES)))
    firm = ["S1-1", "S2-1", "S2-2", "S3-1", "S3-9"]
    for i, a in enumerate(firm):
        for b in firm[i + 1 :]:
            assert (a, b) in got, (a, b)
    assert {("S1-2", "S2-3"), ("S1-2", "S2-4"), ("S2-3", "S2-4")} <= got
    for a, b in (("S1-1", "S3-2"), ("S1-1", "S3-3"), ("S1-2", "S2-5"), ("S2-3", "S2-5"), ("S1-3", "S2-6")):
        assert (a, b) not in got
    assert all(a < b for a, b in got)
    assert linked(names.spelling_pairs(records_of(spark, NAMES).limit(0))) == set()
    long = records_of(spark, [("S1-1", "word " * 20000, "x", "US"), ("S1-2", "word " * 20000 + "end", "x", "US")])
    assert linked(names.spelling_pairs(long)) == set()


def test_exact_words_win(spark):
    """A plain word isn't a misspelt dictionary word, an abbreviation needs a name beside it, umlauts and initials are read."""
    pairs_ = [("Alex Brown", "Alex Crown"), ("James Woods", "James Foods"), ("Car Rental Co", "Car Dental Co"), ("Tex Williams", "Williams Textiles")]
    rows = [(f"S{s}-{i}", n, "x", "US") for i, pair in enumerate(pairs_) for s, n in enumerate(pair, 2)]
    assert linked(names.spelling_pairs(records_of(spark, rows))) == set()
    rows = [("S2-1", "Müller GmbH", "x", "Germany"), ("S3-1", "Mueller", "x", "Germany"), ("S2-2", "IBM Corp", "x", "US"), ("S3-2", "International Business Machines", "x", "US"), ("S2-3", "One Two Three Four Five Six", "x", "US"), ("S3-3", "One TwoThree Four Five Six", "x", "US")]
    assert linked(names.spelling_pairs(records_of(spark, rows))) == {("S2-1", "S3-1"), ("S2-2", "S3-2"), ("S2-3", "S3-3")}


def test_affixes_are_learned(spark):
    w = [a.lower() for x in words(40) for a in x[:2]]
    firms = [f"{a} {b}" for a, b in zip(w[::2], w[1::2])]
    rows = [(n, n) for f in firms for n in (f, f"zentral {f}", f"{f} zapfhahn")]
    common, leads, trades = names.vocabulary(spark.createDataFrame(rows, "value string, text string"))
    assert leads == ["zentral"] and trades == ["zapfhahn"] and common == {"zentral": 40, "zapfhahn": 40}


def test_hot_values_are_split(spark, monkeypatch):
    monkeypatch.setattr(pairs, "ENTITIES_A_PART", 7)
    entities = spark.createDataFrame([(f"e{i:03d}", "ab"[i % 2] if i < 60 else f"v{i}") for i in range(90)], "entity_id string, value string")
    got = [tuple(r) for r in pairs.expand(spark.createDataFrame([("a", "b"), ("a", "v61")], "value_a string, value_b string"), entities).collect()]
    want = {(min(x, y), max(x, y)) for i in range(0, 60, 2) for x in [f"e{i:03d}"] for y in [f"e{j:03d}" for j in (*range(1, 60, 2), 61)]}
    assert len(got) == len(set(got)) and set(got) == want


ADDRESSES = [
    ("S1-1", "n", "902 South Lastovo Street, Gravofield, OS 22259", "US"), ("S2-1", "n", "902 S. Lastovo St, Suite 4, Gravofield, Ostrea 22259", "US"), ("S2-2", "n", "22259, Gravofield, 902 Lastovo Str", "US"), ("S2-3", "n", "Fl. 3; 0902 S Lastvo St; 22259", "US"),
    ("S3-1", "n", "902 North Lastovo Street, Gravofield, OS 22259", "US"), ("S3-2", "n", "903 South Lastovo Street, Gravofield, OS 22259", "US"), ("S3-3", "n", "902 South Lastovo Street, Prabuville, OS 11111", "US"), ("S3-4", "n", "P.O. Box 902, Gravofield", "US"), ("S3-5", "n", "null", "US"), ("S3-6", "n", None, "US"),
    ("S1-5", "n", "391 rue de la Kispuhe, 41653 Brabumont", "France"), ("S2-5", "n", "Bât. A, 391, r Kispuhe, Brabumont CEDEX", "France"), ("S1-6", "n", "Plot 597, Vuspitri Marg, Klabaabad, 405305, UT", "India"), ("S2-6", "n", "H.No. 597, Vuspitri Mg, Opp. City Mall, Klabaabad", "India"),
]


def test_addresses(spark):
    got = linked(addresses.location_pairs(records_of(spark, ADDRESSES)))
    place = ["S1-1", "S2-1", "S2-2", "S2-3"]
    for i, a in enumerate(place):
        for b in place[i + 1 :]:
            assert (a, b) in got, (a, b)
    assert {("S1-5", "S2-5"), ("S1-6", "S2-6")} <= got
    for a, b in (("S1-1", "S3-1"), ("S1-1", "S3-2"), ("S1-1", "S3-3"), ("S1-1", "S3-4"), ("S3-5", "S3-6")):
        assert (a, b) not in got
    assert linked(addresses.location_pairs(records_of(spark, ADDRESSES).limit(0))) == set()


@pytest.mark.parametrize(
    ("address", "number", "street", "postcode"),
    [
        ("123 Martin Luther King Blvd, Dallas, TX 75201", "123", "martinlutherking", "75201"), ("350 5th Ave, New York, NY 10118", "350", "5th", "10118"), ("12 Old Mill Creek Rd, Austin TX", "12", "oldmillkreek", ""), ("Plot 14, MG Road, Bengaluru 560001", "14", "mg", "560001"),
        ("12 Broadway, New York", "12", "broadvay", ""), ("Hauptstrasse 5, 10115 Berlin", "5", "haupt", "10115"), ("221B Baker Street, London", "221", "baker", ""), ("12 avenue des Champs Élysées, 75008 Paris", "12", "khampselysees", "75008"), ("600 Lexington Raod, New York", "600", "lexington", ""),
        ("0150 Oslo", "", None, ""), ("38873 Slivago", "", None, "38873"), ("P.O. Box 12, Austin", "", None, ""), ("12-14 Main Street, Foo", "12", "main", ""), ("Calle Mayor 5, 28013 Madrid", "5", "mayor", "28013"),
    ],
)
def test_real_addresses(address, number, street, postcode):
    found = addresses.parse_place(address)
    assert (found["number"], found["postcode"]) == (number, postcode) and (street in found["words"] if street else not found["words"])


def test_hierarchical_keys(spark):
    """A street misspelt twice joins by postcode and number; another street there doesn't, nor the same one in another town; regions alone are compared too."""
    rows = [("S1-1", "n", "12 Baker Street, London 10001", "x"), ("S2-1", "n", "12 Kingsbridge Road, Gravofield 22259", "x"), ("S3-1", "n", "12 Kngsbrdge Road, 22259", "x"), ("S3-2", "n", "12 Queensway Road, Gravofield 22259", "x"), ("S3-3", "n", "221B Baker Street, York", "x"), ("S3-4", "n", "221 Baker St, York", "x"), ("S3-5", "n", "221 Baker St, Leeds", "x")]
    assert linked(addresses.location_pairs(records_of(spark, rows))) == {("S2-1", "S3-1"), ("S3-3", "S3-4")}
    wide = [("S2-%03d" % i, "n", f"{i} Some{'abcdefghij'[i % 10]}lane Road, {'Northland' if i % 2 else 'Southland'}", "x") for i in range(100, 160)]
    rows = [("S1-1", "n", "12 Main Street, Northland", "x"), ("S1-2", "n", "12 Main St, Southland", "x"), ("S1-3", "n", "12 Main St., Northland", "x"), *wide]
    assert linked(addresses.location_pairs(records_of(spark, rows))) == {("S1-1", "S1-3")}


LOOKS = [
    ("S1-1", "Hair Studio", "12 Main St", "US"), ("S2-1", "Ηаіr Ѕtudіо", "１２　Ｍａｉｎ　Ｓｔ", "US"), ("S2-2", "Hair​ Studio", "12 Main St.", "US"), ("S2-3", "Hair\u00a0Studio", None, "US"), ("S2-4", "hair Studio", "", "US"), ("S2-5", "Hair  Studio", " ", "US"),
    ("S3-1", "Café", "a", "US"), ("S3-2", "Cafe\u0301", "a", "US"), ("S3-3", "Cafe", "​", "US"), ("S3-4", "A\u04cfan", "a", "US"), ("S3-5", "Alan", "a", "US"), ("S3-5", "Alan", "a", "US"),
]


def test_lookalikes(spark):
    got = {tuple(r) for r in lookalike.lookalike_pairs(records_of(spark, LOOKS)).select("id_a", "id_b", "field_name").collect()}
    same = ["S1-1", "S2-1", "S2-2", "S2-3"]
    want = {(a, b, "business_name") for i, a in enumerate(same) for b in same[i + 1 :]} | {("S1-1", "S2-1", "business_address"), ("S3-1", "S3-2", "business_name"), ("S3-4", "S3-5", "business_name")}
    assert got == want
    assert lookalike.lookalike_pairs(records_of(spark, LOOKS).limit(0)).count() == 0


def test_trie_chooses_the_vocabulary():
    assert lookalike.Trie(["Ivan"]).match("\u04cfvan") == (lookalike.LESS_LIKELY, "Ivan") and lookalike.Trie(["lake"]).match("\u04cfake") == (0, "lake")
    assert lookalike.Trie(["xy"]).match("x\u200by") == (0, "xy") and lookalike.Trie(["xy"]).match("xz") is None


def test_costs_decide():
    """Two readings are words: the likelier one wins, whatever the order. Edits that change the looks cost a whole and are found only within a greater bound."""
    for words_ in (["lake", "Iake"], ["Iake", "lake"]):
        assert lookalike.Trie(words_).match("\u04cfake") == (0, "lake")
    trie = lookalike.Trie(["Bakery", "Baker", "Bread"])
    assert trie.match("\u0412ak\u0435ry") == (0, "Bakery") and trie.match("Bakary") is None
    assert trie.match("B\u0430kary", bound=1) == (1, "Bakery") and trie.match("Bakry", bound=1) == (1, "Bakery") and trie.match("Breaad", bound=1) == (1, "Bread")


def test_vocabulary_has_no_bound(spark):
    """A word that is seen once decides, however many words there are; accented words and mathematical letters are read by the table."""
    many = [(f"e{i}", "business_name", f"Word{i} ready") for i in range(3000)]
    odd = [("a1", "business_name", "\u04cfvanhoe 7"), ("a2", "business_name", "Ivanhoe 7"), ("b1", "business_name", "\U0001d400\ua4ef\u13d4 x"), ("c1", "business_name", None), ("c2", "business_name", "")]
    got = {r.entity_id: r.form for r in lookalike.one_form(spark.createDataFrame(many + odd, "entity_id string, field_name string, value string")).collect()}
    assert len(got) == 3005 and got["a1"] == got["a2"] == "Ivanhoe 7" and got["b1"] == "A\ua4efW x" and got["c1"] is None and got["c2"] == "" and got["e7"] == "Word7 ready"


def test_pairs_within_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS_A_PART", 7)
    rows = [("k" if i < 60 else f"k{i}", i, f"v{i % 3}") for i in range(90)]
    got = {(r.id_a, r.id_b) for r in pairs.pairs_within(spark.createDataFrame(rows, "k string, i long, v string"), ["k"], "i", "v").collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3}


def test_plain():
    assert plain.plain("  N/A ") == "" and plain.plain(None) == "" and plain.plain("Électricité") == "electricite" and plain.plain("विफुजेफे") == "viphujephe"
    assert plain.heard("viphujephe") == "vifujefe" and plain.near("abcd", "abdc") and not plain.near("abcd", "badc")


def test_every_neighbour_is_a_rewriting(spark):
    frequent = ["kamoset", "kemoset", "kimoset", "komoset", "kumoset", "kmoset"]
    got = plain.rewritings(spark.createDataFrame([("kymoset", 1), *((w, 10 + i) for i, w in enumerate(frequent))], "word string, n long"))
    assert {r.form for r in got.where("word = 'kymoset'").collect()} == {"kymoset", *frequent}


# vectors -----------------------------------------------------------------------------------------------------------------


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    rows = []
    for i in range(240):
        v = base[i % 40] + 0.3 * rng.standard_normal(64) if i < 200 else base[0]
        rows.append((f"S2-{i:04d}", "name", [float(x) for x in v.astype(np.float32)], "extra"))
    rows += rows[:5] + [("S2-9990", "name", None, ""), ("S2-9991", "name", [], ""), ("S2-9992", "name", [0.0] * 64, ""), ("S2-9993", "name", [1.0] * 63, ""), ("S2-9994", "both", [1.0] * 64, ""), ("S2-9995", "both", [2.0] * 64, "")]
    df = spark.createDataFrame(rows, "entity_id string, view_name string, vec array<float>, value string")
    got = {(r.entity_id, r.near_id) for r in neighbours.nearest_entities(df).where("view_name = 'name'").collect()}
    own = {r[0]: np.array(r[2]) for r in rows[:240]}
    ids = sorted(own)
    x = np.array([own[i] / np.linalg.norm(own[i]) for i in ids])
    want = set()
    for i, e in enumerate(ids):
        s = x @ x[i]
        s[i] = -9
        want |= {(e, ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-round(s[j], 9), ids[j]))[:5]}
    assert len(got & want) / len(want) >= 0.97 and len(got) == len(want)
    assert {(r.entity_id, r.near_id) for r in neighbours.nearest_entities(df).where("view_name = 'both'").collect()} == {("S2-9994", "S2-9995"), ("S2-9995", "S2-9994")}
    assert neighbours.nearest_entities(df.limit(0)).count() == 0


def test_cells_follow_the_classes(spark, monkeypatch):
    """With a small sample cells still hold about CELL_ROWS classes each, dense cells are split, and neighbours are found."""
    for name, value in (("CELL_ROWS", 20), ("FIT_ROWS", 120), ("ASKING_ROWS", 16), ("STORED_ROWS", 48)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((60, 64))
    x = np.array([base[i % 60] + 0.4 * rng.standard_normal(64) for i in range(1500)])
    x[:500] = base[0] + 0.4 * rng.standard_normal((500, 64))  # a dense cell
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    first, second = neighbours.codebooks(x[:120].astype(np.float64), 1500)
    assert len(first) == 16 and len(second) == 5
    cells = neighbours.nearest_cells(x, first, second)
    assert cells.shape == (1500, 8) and all(len(set(c)) == 8 for c in cells)
    centres = (first[:, None] + second[None]).reshape(-1, 64)
    for i in range(0, 1500, 100):
        assert cells[i, 0] == np.argmin(((x[i] - centres) ** 2).sum(axis=1))
    df = spark.createDataFrame([(f"S2-{i:04d}", "name", v.tolist()) for i, v in enumerate(x)], "entity_id string, view_name string, vec array<float>")
    got = {(r.entity_id, r.near_id) for r in neighbours.nearest_entities(df).collect()}
    s = x.astype(np.float64) @ x.T
    np.fill_diagonal(s, -9)
    want = {(f"S2-{i:04d}", f"S2-{j:04d}") for i in range(1500) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_error_bound():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scalar = neighbours.encode(x)
    guess, factor = neighbours.estimate(codes, scalar, (x[:50] @ neighbours.rotation().T).astype(np.float32))
    true = x[:50] @ x.T
    assert codes.shape == (500, 8)
    assert (np.abs(guess - true) <= np.sqrt(np.maximum(1 - true**2, 0)) * factor + 1e-4).mean() > 0.98


# matching ----------------------------------------------------------------------------------------------------------------


def test_matching(spark):
    rows = [(f"S1-{i:03d}", f"{a} {b} Bakery Ltd", f"{i + 1} {c} Street, Gravofield, OS 22259", "US") for i, (a, b, c) in enumerate(words(40))]
    true = [(r[0], f"S2-{r[0][3:]}") for r in rows]
    pool = [(f"S2-{r[0][3:]}", r[1].replace("Bakery Ltd", "Bkry"), r[2].replace("Street", "St") if i % 5 else None, "US") for i, r in enumerate(rows)]
    branch = [(f"S3-{r[0][3:]}", r[1], f"{i + 500} Other Road, Prabuville, OS 11111", "US") for i, r in enumerate(rows)]
    records = records_of(spark, rows + pool + branch + [("S2-900", None, None, None), ("S2-901", "N/A", "null", "")])
    labels = spark.createDataFrame([(a, b, True) for a, b in true] + [(a, "S3" + b[2:], False) for a, b in true] + [("S1-000", "S2-001", None)], "s1_id string, cand_id string, y boolean")
    got = matching.matches(records, labels).collect()
    assert {(r.s1_id, r.cand_id) for r in got} == set(true) and all(0.5 <= r.confidence <= 1 for r in got)
    assert matching.matches(records.limit(0), labels).count() == 0
    assert {(r.s1_id, r.cand_id) for r in matching.matches(records, labels.limit(0)).collect()} >= {t for i, t in enumerate(true) if i % 5}


def test_bands_are_joined_whole(spark, monkeypatch):
    """Many records in one band, by names alike but not the same: those without a number and a postcode stay, and so do those with only one of them."""
    a = "f zuvomarelikotunapesidovagurike belotanimurasolipedukagovetin"
    places = [([], ""), (["12 marg"], ""), ([], "560001")]
    rows = [(f"{'S1' if s1 else 'S2'}-{i}", s1, [{"key": a if s1 else a[:-1] + "m"}], {"postcode": places[i % 3][1]}, places[(i + s1) % 3][0]) for s1 in (True, False) for i in range(50)]
    people = spark.createDataFrame(rows, "entity_id string, s1 boolean, names array<struct<key:string>>, place struct<postcode:string>, keys array<string>")
    for most in (matching.RECORDS_A_PART, 7):
        monkeypatch.setattr(matching, "RECORDS_A_PART", most)
        got = [tuple(r) for r in matching.candidates(people).collect()]
        assert len(got) == len(set(got)) == 2500 and all(s.startswith("S1-") and c.startswith("S2-") for s, c in got)


def test_minhash_estimates_overlap():
    forms = ["f zuvomarelikotunapesi", "f zuvomarelikotunapesi x", "f kemosudo crarisi", "f kemosdo crarisi", "ab", "", "字母表"]
    m = matching.minhash(forms, 600)
    triples = [{f.ljust(3)[i : i + 3] for i in range(max(1, len(f) - 2))} for f in forms]
    for i in range(len(forms)):
        for j in range(len(forms)):
            assert abs((m[i] == m[j]).mean() - len(triples[i] & triples[j]) / len(triples[i] | triples[j])) < 0.08


def words(n):
    rng = random.Random(9)
    w = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    return [(w(), w(), w()) for _ in range(n)]


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w = matching.fit_logistic(x, y, penalty=1e-6)
    assert np.abs(w - [2, -1, 0.5]).max() < 0.3
    assert not matching.fit_logistic(x, np.ones(2000)).any()


# tokens ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def machine():
    return bpe.transducer(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def plainly(machine):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})


TEXTS = ["", "a", "Hello world's  end\n\n x", "<|endoftext|> is text", "naïve 中文 😀 ठि", " " * 500, "aaaa" * 400, "\x00\x1c\x1f\x7f \t", "日本語" * 50, "x" * 70000, "=-" * 3000]


def test_encoding_is_merging(machine, plainly):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aeiou trns\n\t01é中😀'\"\\{}$\x1c\u2028") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        assert machine.encode(t) == plainly.encode_ordinary(t)
        assert "".join(machine.decode(machine.encode(t))) == t
    assert machine.encode(None) == [] and machine.count(None) == 0


def test_streams(machine, monkeypatch):
    rng = random.Random(12)
    for data in (b" " * 2000, b"abcabc" * 500, "ज़".encode() * 300, bytes(rng.choice(b"abelmnort") for _ in range(5000)), b"a" * 5000):
        monkeypatch.setattr(bpe, "LONG_CHUNK", 10**9)
        whole = list(machine.encode_bytes(data))
        assert list(machine.stream(data)) == whole
        monkeypatch.setattr(bpe, "LONG_CHUNK", 1_024)
        assert list(machine.encode_bytes(data)) == whole
        fed, out = [], 0
        for _ in machine.stream(fed.append(b) or b for b in data):  # tokens come before the end is read
            out += 1
            if out == 1:
                assert len(data) < 2000 or len(fed) <= 4 * bpe.LOOKAHEAD
    text = "é中😀a"
    u = bpe.Utf8Machine()
    assert "".join(u.feed(bytes([b])) for b in text.encode()) + u.close() == text
    for bad in (b"\xff", b"\xe4\xb8", b"\xc0\x80", b"\xed\xa0\x80", b"\xf5", b"a\x80b"):
        u = bpe.Utf8Machine()
        assert "\ufffd" in u.feed(bad) + u.close()


def test_arcs_are_dropped_not_results(plainly, monkeypatch):
    monkeypatch.setattr(bpe, "ARCS_KEPT", 20)
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 5)
    m = bpe.Transducer(bpe.transducer(bpe.default_vocabulary()).ranks)
    for t in TEXTS[:6] * 2:
        assert m.encode(t) == plainly.encode_ordinary(t)


def test_corpus(spark, plainly):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(1, "a", "x")]
    got = sorted((r.doc_id, list(r.ids)) for r in encoding.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect())
    assert got == sorted((i, plainly.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert encoding.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    back = sorted((r.doc_id, r.text) for r in encoding.decode_corpus(encoding.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string"))).collect())
    assert back == sorted((i, t or "") for i, t, _ in rows)


# packing -----------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, None, 1, 700, rng.randint(1, 4096), rng.randint(1, 9000)])) for i in range(1500)] + [(3, 4096), (3, 4096), (7, 12288)]
    for shard in (16_000, 200):
        got = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), items_a_shard=shard).collect()
        total, segments = {}, {}
        for r in got:
            total[r.container_id] = total.get(r.container_id, 0) + r.n_tokens
            segments[r.container_id] = segments.get(r.container_id, 0) + 1
        assert max(total.values()) <= 4096 and max(segments.values()) <= packing.SEGMENTS
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
        want = {}
        for d, n in sizes:
            n = n or 0
            want.setdefault(d, []).extend((k, k * 4096, min(4096, n - k * 4096)) for k in range(max(1, -(-n // 4096))))
        assert {d: sorted(x) for d, x in by.items()} == {d: sorted(x) for d, x in want.items()}
        need = sum(n or 0 for _, n in sizes) / 4096
        assert len(total) <= need * 1.02 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_loss_limit_binds(spark):
    """Four texts fill a container; without masked tokens only two keep the loss limit, so the limit decides what is put together."""
    sizes = spark.createDataFrame([(i, 1024, 0 if i % 2 else 900) for i in range(400)], "doc_id long, n_tokens long, n_masked long")
    for loss in (packing.CAPACITY, 2_200):
        got = packing.pack(sizes, loss=loss).collect()
        by = {}
        for r in got:
            by.setdefault(r.container_id, []).append(1023 if r.doc_id % 2 else 124)
        assert sum(map(len, by.values())) == 400 and max(map(sum, by.values())) <= loss
        assert len(by) == 100 if loss == packing.CAPACITY else 104 <= len(by) <= 130
    long = packing.pack(spark.createDataFrame([(1, 9000, 5000), (2, 4090, 0), (3, 90, 90), (4, 6, 0)], "doc_id long, n_tokens long, n_masked long")).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in long) == [(1, 0, 4096), (1, 1, 4096), (1, 2, 808), (2, 0, 4090), (3, 0, 90), (4, 0, 6)]
    assert len({r.container_id for r in long if r.doc_id in (2, 4)}) == 2


def test_every_limit_holds():
    items = np.array([[10, 1, 90]] * 5 + [[90, 1, 5]] * 5)
    where = packing.fill(items, np.array([100, 2, 100]))
    for k in set(where):
        assert (items[where == k].sum(axis=0) <= [100, 2, 100]).all()
    assert len(set(where)) == 5


# pages -------------------------------------------------------------------------------------------------------------------

PROSE = "We show that the cost of one update grows with the size of the graph and not with the number of samples. The results agree with those of earlier work, and the model is stable for larger tensors as well. It follows that the estimator is linear in the residual, which was not known before. "


def test_pages(spark):
    rng = random.Random(5)
    words_ = [f"{a}{b}" for a in ("smooth", "linear", "finite", "local", "sparse", "global") for b in ("mesh", "flow", "graph", "layer")]
    prose = PROSE + " ".join(f"The {rng.choice(words_)} is {rng.choice(words_)} for the {rng.choice(words_)} of a {rng.choice(words_)}, and it is not {rng.choice(words_)}." for _ in range(30))
    spam = {
        1: "cheap thesis help, used laptop, " * 60,
        2: "\\documentclass{article}\\title{The title of it}\\begin{document}\\begin{itemize}" + "".join(f"\\item \\href{{http://x{i}.example/used-laptop}}{{used laptop}}" for i in range(30)) + "\\end{itemize}",
        3: " ".join(f"#UsedLaptop{i}" for i in range(40)),
        4: "\n".join(f"Gravalo A-{i} / used laptop / {i}.95 EUR / SKU {7 * i}" for i in range(30)),
        5: "http://a.test/used-laptop\n" * 12,
        6: "Looking for used laptop? Our used laptop is the used laptop you want, used laptop now! Order used laptop today. " * 12,
    }
    fair = {
        11: prose, 12: "", 13: None, 14: "   \n", 15: "\\input{main}", 16: "\n".join(" & ".join(str(i * j) for j in range(6)) for i in range(60)),
        17: "\n".join(f"\\bibitem{{k{i}}} A. {a}, \\emph{{On the {b} of a {words_[i % 24]} {c}}}, J. {b} Stud. {i * 3} ({1960 + i})." for i, (a, b, c) in enumerate(words(40))),
        18: PROSE + "See \\url{http://x.example} and \\url{http://y.example}.", 19: prose * 60,
    }
    rows = [(i, t, "en", "x") for i, t in {**spam, **fair}.items()] + [(30 + k, prose + f" The {w} is here.", None, "x") for k, w in enumerate(words_)] + [(1, spam[1], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share string")
    got = [r.doc_id for r in stuffing.stuffed_pages(df).collect()]
    assert sorted(set(got)) == sorted(spam)
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0
    assert stuffing.rank_curves(df).count() == len(rows) or stuffing.rank_curves(df).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_extreme_curves_decide(spark, monkeypatch):
    """A page of one phrase has a fair share of function words: its curve flags it, and nothing else does. A page as short of function words but varied stays."""
    rng = random.Random(7)
    terms = [f"{a}{b}" for a in ("smooth", "linear", "finite", "local", "sparse", "global", "noisy", "weak") for b in ("mesh", "flow", "graph", "layer", "tensor", "index")]
    prose = lambda k: " ".join(f"The {rng.choice(terms)} of {rng.choice(terms)} is {rng.choice(terms)} for the {rng.choice(terms)}, and it is not {rng.choice(terms)}." for _ in range(k))
    rows = [(i, prose(14 + i % 5), "en") for i in range(60)]
    rows += [(100, "Looking for used laptop? Our used laptop is the used laptop you want now. " * 14, "en"), (101, " ".join(f"On the w{'abcdefghij'[i % 10]}{'klmnopq'[i // 10]}ra of z{'abcdefghij'[i // 7]}{'rstuvwx'[i % 7]}lo u{'abcdefg'[i % 7]}{'hijklmnopq'[i // 7]}ta" for i in range(70)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    curves = {r.doc_id: r for r in stuffing.rank_curves(df).where("doc_id >= 100").collect()}
    assert all(curves[i].divergence < stuffing.DIVERGENCE for i in (100, 101)) and curves[100].divergence >= stuffing.WITH_CURVE
    assert [r.doc_id for r in stuffing.stuffed_pages(df).collect()] == [100]
    monkeypatch.setattr(stuffing, "STEEP", 1e9)
    monkeypatch.setattr(stuffing, "UNEVEN", 1e9)
    assert stuffing.stuffed_pages(df).count() == 0
