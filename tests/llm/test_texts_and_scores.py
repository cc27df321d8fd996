import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm.distinctive import best_terms, fit_mixtures, term_scores
from skein.llm.eval_leaks import leak_report, leaked_items
from skein.llm.mixture import mixture, text_weight
from skein.llm.residue import residue, residue_documents, residue_of, without_residue
from skein.llm.split_overlap import overlap_report, split_overlaps
from skein.llm.top_items import LoserTree, _Run, merge_runs, top_items
from skein.llm.words import words_of

import numpy as np


def two(df):
    return sorted(tuple(r) for r in df.collect())


# Top items


def test_top_items_match_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", f"g{rng.randrange(40)}"]), f"t{rng.randrange(60):02}", rng.choice([0.0, 0.5, 0.5, 0.9, 1.0, -1.0, 1.5, float("nan"), None])) for _ in range(3000)]
    rows += [(None, "t", 0.5), ("g1", None, 0.5)]
    best = defaultdict(dict)
    for g, t, s in rows:
        if g and t and s is not None and 0 <= s <= 1:
            best[g][t] = max(best[g].get(t, -1), s)
    want = sorted((g, t, s, r) for g, items in best.items() for r, (t, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:4], 1))
    monkeypatch.setattr("skein.llm.top_items.RUN_ROWS", 200)
    df = spark.createDataFrame(rows, "s_id string, t_id string, score double").withColumns({"bucket": F.lit("x"), "run": F.lit(1)}).repartition(5)
    assert two(top_items(df, 4)) == want
    assert two(top_items(df, 4, bucket_rows=100)) == want
    assert top_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        top_items(df, 0)


def run_of(rows):
    ends, i = [0] * len(rows), len(rows)
    for k in range(len(rows) - 1, -1, -1):
        if k + 1 < len(rows) and rows[k + 1][0] != rows[k][0]:
            i = k + 1
        ends[k] = i
    return _Run([0] * len(rows), [r[0] for r in rows], [r[2] for r in rows], [-r[1] for r in rows], ends)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_loser_tree_merges_and_seeks(k):
    rng = random.Random(k)
    runs = [sorted({(f"g{rng.randrange(5)}", -rng.randrange(9) / 10, f"i{rng.randrange(30)}") for _ in range(rng.randrange(0, 40))}) for _ in range(k)]
    tree = LoserTree([run_of(r) for r in runs])
    merged = []
    while (key := tree.runs[tree.winner].key) is not None:
        merged.append(key[1:])
        tree.runs[tree.winner].next()
        tree.play(tree.winner)
    assert merged == sorted(x for r in runs for x in r)
    seen, want = defaultdict(list), []
    for g, s, i in sorted(x for r in runs for x in r):
        if i not in seen[g] and len(seen[g]) < 3:
            seen[g].append(i)
            want.append((g, i, -s, len(seen[g])))
    assert [r[1:] for r in merge_runs([run_of(r) for r in runs], 3)] == want


# Terms


def test_term_scores(spark):
    rows = [(1, "Heart heart valve", ["the heart"], "x"), (2, "toe", None, "x"), (3, None, ["Toe the", None, ""], "x"), (4, None, None, "x"), (5, "??", [], "x"), (None, "heart", None, "x")]
    df = spark.createDataFrame(rows, "row_id long, canonical_name string, aliases array<string>, term string")
    counts = {i: Counter(words_of(" ".join([n or "", *[a or "" for a in al or []]]))) for i, n, al, _ in rows if i}
    d = Counter(t for c in counts.values() for t in c)
    want = {(i, t): round(tf * math.log(len(rows) / d[t] + 1), 9) for i, c in counts.items() for t, tf in c.items()}
    got = {(r["row_id"], r["term"]): r for r in term_scores(df).collect()}
    assert {k: r["score"] for k, r in got.items()} == pytest.approx(want)
    assert got[(1, "heart")]["tf"] == 3 and all(0 <= r["elite"] <= 1 for r in got.values())
    best = {i: min((-s, t) for (j, t), s in want.items() if j == i)[1] for i in counts if counts[i]}
    assert dict(two(best_terms(df))) == best
    assert set(dict(two(best_terms(df, by="elite")))) == set(best)
    assert best_terms(df.limit(0)).count() == 0


def test_two_poisson_fit_separates_rates():
    rng = np.random.default_rng(3)
    terms, counts, records = [], [], []
    for i, (share, high, low) in enumerate([(0.1, 6, 0.2), (0.3, 90, 2), (0.02, 12, 0.05)]):  # counts of any height have a bin of their own
        tf = np.where(rng.random(20_000) < share, rng.poisson(high, 20_000), rng.poisson(low, 20_000))
        k, n = np.unique(tf[tf > 0], return_counts=True)
        terms += [i] * len(k)
        counts, records = np.append(counts, k), np.append(records, n)
    share, high, low, converged = fit_mixtures(np.array(terms), counts, records, 20_000)
    assert converged.all()
    assert np.allclose(share, [0.1, 0.3, 0.02], atol=0.02) and np.allclose(high, [6, 90, 12], rtol=0.06) and np.allclose(low, [0.2, 2, 0.05], rtol=0.2)


def test_vectorised_fit_equals_one_term_at_a_time():
    rng = np.random.default_rng(8)
    histograms = [np.unique(rng.poisson(rng.choice([0.3, 1, 5]), rng.integers(1, 60)) + 1, return_counts=True) for _ in range(200)]
    term = np.repeat(np.arange(200), [len(k) for k, _ in histograms])
    together = fit_mixtures(term, np.concatenate([k for k, _ in histograms]), np.concatenate([n for _, n in histograms]), 500)
    for i, (k, n) in enumerate(histograms):
        alone = fit_mixtures(np.zeros(len(k), int), k, n, 500)
        assert all(np.isclose(a[0], b[i], rtol=1e-9) for a, b in zip(alone, together))


def test_elite_records_are_recovered(spark):
    """Planted: a term occurs about 8 times in its elite records and rarely elsewhere."""
    rng = np.random.default_rng(5)
    elite = rng.random(2000) < 0.1
    times = np.where(elite, rng.poisson(8, 2000), rng.poisson(0.1, 2000))
    rows = [(i, "filler", ["planted"] * int(x)) for i, x in enumerate(times)]
    df = spark.createDataFrame(rows, "row_id long, canonical_name string, aliases array<string>")
    got = {r["row_id"]: r["elite"] for r in term_scores(df).where("term = 'planted'").collect()}
    right = sum((got.get(i, 0.0) > 0.5) == bool(e) for i, e in enumerate(elite))
    assert right >= 0.98 * 2000


# Leaks


def test_leaks_match_brute_force(spark, tmp_path):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 13, 40])))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        source = (items[rng.randrange(12)][1] or "").split()
        if rng.random() < 0.6 and source:
            a = rng.randrange(len(source))
            piece = source[a : a + rng.randint(5, 20)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "--", "\r\n"]) for w in piece]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (None, docs[1][1])]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words_of(t)] for i in range(len(w) - 11)}
    want = sorted((d, i) for d, t in docs for i, u in items if d is not None and grams(t) & grams(u))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "n": F.lit(1)})
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("split", F.lit("dev"))
    assert want and two(leaked_items(df, it)) == want
    assert two(leaked_items(df, it, block_shingles=40)) == want  # several blocks of items
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0
    long = {i for i, t in items if len(words_of(t)) >= 12}
    assert two(leak_report(df, it)) == sorted((i, i in long, sum(1 for _, j in want if j == i) if i in long else None) for i, _ in items)
    df.write.parquet(f"{tmp_path}/corpus")
    found = leaked_items(spark.read.parquet(f"{tmp_path}/corpus"), it)
    assert two(found) == want and not any("corpus" in f for f in found.inputFiles())  # read once, by the scan whose stretches are saved


# Overlap of splits

E = "struct<research_entity_id:string,canonical_name:string,aliases:array<string>,definition:string>"


def test_split_overlaps_match_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    hub = [f"hub{i}" for i in range(12)]
    for i in range(260):
        if rows and rng.random() < 0.5:
            base = list(rng.choice(rows)[5])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(rng.choice(vocab))
        else:
            base = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 20, 40]))] + (hub if rng.random() < 0.3 else [])
        rng.shuffle(base)
        cut = len(base) // 2
        a = (None, " ".join(base[:cut]).upper(), [None, " ".join(base[cut:])], None)
        b = (None, None, None, "") if rng.random() < 0.9 else None
        rows.append((i, rng.choice(["train", "dev", "test", None, "other"]), "o", a, b, base))
    sets = {r[0]: set(r[5]) for r in rows}
    split = {r[0]: r[1] for r in rows}
    ids = [i for i in sets if sets[i]]
    want = sorted(
        (min(a, b), max(a, b)) for a in ids for b in ids if split[a] == "train" and split[b] in ("dev", "test") and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    )
    df = spark.createDataFrame([r[:5] for r in rows], f"pair_id long, split string, origin string, source_ent {E}, target_ent {E}").withColumns({"key": F.lit(1), "toks": F.lit(2)})
    assert want and two(split_overlaps(df.repartition(6))) == want
    assert split_overlaps(df.limit(0)).count() == 0
    report = overlap_report(df).toPandas()
    assert set(report["split"]) == {"dev", "test"} and report["n_found"].sum() == len({x for p in want for x in p if split[x] != "train"})
    with pytest.raises(ValueError):
        split_overlaps(df, threshold=0.4)


# Mixture


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big", "Big ", "BIG"]) if i < 700 else "small-one" if i < 740 else None if i < 760 else "unlisted", " ".join(["word"] * rng.randint(1, 30))) for i in range(800)]
    docs += [(900, "big", None), (901, "big", ""), (None, "big", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("key", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = mixture(df, targets)
    rows = drawn.toPandas()
    assert not rows["doc_id"].isin([900, 901]).any() and set(rows["source"]) == {"big", "small_one"}
    small = rows[rows["source"] == "small_one"]
    assert len(small) == 40 and (small["copies"] == 3).all()  # its budget exceeds what it may give
    total = {s: rows[rows["source"] == s]["tokens"].sum() for s in ("big", "small_one")}
    everything = sum(len(t.split()) for i, s, t in docs if t and i is not None and s and s.strip().lower().replace("-", "_") in ("big", "small_one"))
    assert abs(total["big"] - 0.5 * everything) <= 30 and rows[rows["source"] == "big"]["copies"].max() == 1
    report = {r["source"]: r for r in shares.collect()}
    assert report["absent"]["tokens"] == 0 and report["absent"]["share"] == 0 and sum(r["share"] for r in report.values()) == pytest.approx(1, abs=1e-5)
    exact = {r["source"]: r["share"] for r in mixture(df, targets, exact=True)[1].collect()}
    assert exact["big"] == pytest.approx(5 / 9, abs=0.03)
    epochs = mixture(df, targets, total_tokens=int(total["small_one"] * 2.5 / 0.4))[0].where("source = 'small_one'").toPandas()
    assert set(epochs["copies"]) == {2, 3}  # two complete epochs, then part of a third
    assert two(mixture(df.repartition(3), targets)[0]) == two(drawn)
    assert mixture(df.limit(0), targets)[0].count() == 0


def test_mixture_of_low_weights_and_repeated_targets(spark):
    """Very unequal weights spread over the key buckets; a source listed twice counts once, with the sum of its shares."""
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"), F.when(F.col("id") % 2 == 0, 0.05).otherwise(1.0).alias("w"))
    targets = spark.createDataFrame([("a", 0.1, 1), ("a", 0.15, None)], "source string, target_share double, max_repeats int")
    drawn, shares = mixture(docs, targets, weight=F.col("w"))
    row = shares.collect()
    assert len(row) == 1 and row[0]["target_share"] == pytest.approx(0.25) and abs(row[0]["tokens"] - row[0]["budget"]) <= 6 and row[0]["max_copies"] == 1
    odd = drawn.where("doc_id % 2 = 1").count()
    assert odd > 0.9 * drawn.count()  # a weight 20 times as high


def test_text_weight(spark):
    texts = [(0, "the quick brown fox jumps over the lazy dog while seven small wizards quietly watch from behind an old oak tree near water"), (1, "spam " * 200), (2, "0x1f 99 -- 17; 42"), (3, ""), (4, None)]
    w = {r[0]: r[1] for r in spark.createDataFrame(texts, "i int, text string").select("i", text_weight(F.col("text"))).collect()}
    assert w[0] > 0.9 and w[1] < 0.2 and w[2] < 0.2 and w[3] == 0.05


# Residue

CASES = [
    "Dear {{ first_name }}, your entry is ready.", "Levels rose with ${name} exposure.", "{%- release -%}", "Term: <%= term %>", "by <?=date?> now", "#{item.title} is here", "@@SUMMARY@@",
    "the __first_alias__ of it", "moved to %KB_NAME% today", "%(count)s items", "[[organ]] view", "<<USER>>", "the {definition} was split", "<insert term here>", "[INSERT TERM\nHERE]", "[your organ here]",
    "[TODO: add summary]", "[term to be supplied]", "<code_goes_here>", "<placeholder: DATE>", "{{#user}}", "{{date|default}}",
    "Lorem ipsum dolor sit amet", "Dummy paragraph for layout only.", "Content coming soon.", "This is sample text. Replace it with the definition of your concept before publishing.", "text text text text text text",
    "asdf asdf qwer qwer", "Xxxx xxxxx xxx xxxxxx xx", "Texte provisoire, a remplacer", "Blindtext: Hier", "Your description goes here.", "Write two or three sentences about the term.", "Click to edit this block.",
    "404 Not Found", "Status: 500 Internal\nServer Error", "Sorry, the page you were looking for does not exist.", "This record is unavailable at the moment.", "Fatal error: call to undefined function f()", "Access denied.",
    "Your session has expired.", "SOMETHING WENT WRONG WHILE LOADING THIS ENTRY.", "Die angeforderte Seite wurde nicht gefunden (Fehler 404).", "Page introuvable.", "Interner Serverfehler.", "KeyError in load_term (x), line 3",
    "Please enable JavaScript to view this page.", "TO CONTINUE, ENABLE JS AND RELOAD BEFORE YOU GO ON.", "JavaScript is disabled in your browser.", "You need to allow scripts to run this app.", "Bitte aktivieren Sie JavaScript, um den Eintrag zu sehen.",
    "Veuillez activer JavaScript pour afficher", "scripts and cookies must be on.", "Loading... This viewer requires scripts.", "Dear <<CODE>>, the entry [[RELEASE]] was accepted on [[author_name]].",
]
FINE = [
    None, "", "ok", 'The term "page not found" was searched more often than cluster vessel.', "In the import sheet, a field name in braces, such as {label}, is swapped by the loader.",
    "In formula {x + y} / z the value x is hearing; $z is the cost.", "The locus {q21;q24} was lost in 86 cells, [sic] as soboct wrote.", "The study used the set {A, B, C} of sites, and [65] reports the raw counts.",
    "Set $x$ to the mean, then %CV is 9% and the index __total__ column holds mufint.", "For the query [level] AND [reddish] the index returned 31 hits; for <vodis> it returned none.",
    "Dose is given as <weight in kg> x 0.82 when high.", "Binding of [3H]-x was 12 % above base, p < 0.05, at a price of $4.50 per test.", "A survey counted how often readers met a page that asked them to enable scripts; 39 of 76 did.",
    "The portal is written in JavaScript and shows ketis.", "Nurses noted that the panel showed Error 3 when it ran low.", "Slide 40 of box 404 was not found, so the series has a gap.", "The error code 503 in the analyser log stands for a clot.",
    "The access to the colon was denied by scar tissue.", "Access to care was unavailable in 58 districts.", "Session 404 of the meeting expired without a vote.", 'The phrase "text text text" marked blank cells.', "Early drafts carried filler text for scar.",
    "Mice were placed on a placeholder diet.", "The sample $70.00 fee covers it; TODO lists of the ward were kept.", "Patients who could not be found at follow-up (51 of 71) were counted.", "A timeout of 2 seconds protects the pump.",
    "Skip to content Home | Browse | Search | Help", "The server room was closed, so data came 67 days late.", "Write `{{ name }}` to print a name.\n```\nHello {{ name }}, {{ place }}\n```\nThis prints the name.",
]


#: Templates and messages of other makers than those above, and texts that only resemble them.
OTHER_MAKERS = [
    "404 - Page not found", "You need JavaScript to run this app.", "Dear [Customer Name], thank you", "Dear <FIRST_NAME>,", "Hi %%FIRST%%, see below", "Hello {{ user.name|default('x') }}",
    "{{#each items}}", "{% if user.is_active %}", "{% endif %}", "<%= @user.name %>", "<?php echo $title; ?>", "${order.total}", "Hello, ${user.getName()}!", "{0} missing {first_name}",
    "[INSERT DATE]", "[Your Name]", "[Company Name]", "%FIRSTNAME%", "*|FNAME|* hi [FIRST_NAME]", "{{{body}}}", "{{ t('home.title') }}", "[Enter your address]", "[TBD]", "<insert title>",
    "Error 404", "HTTP Error 503: Service Unavailable", "403 Forbidden", "500 Internal Server Error", "The page you are looking for doesn't exist.", "Sorry, this page isn't available.",
    "We can't find the page you're looking for.", "This site can't be reached", "An unexpected error occurred.", "Something went wrong. Please try again.",
    "java.lang.NullPointerException: null at com.foo.Bar.run(Bar.java:12)", "TypeError: undefined is not a function", "Traceback (most recent call last):", "This video is unavailable.",
    "Service Temporarily Unavailable", "You are not authorized to view this page.", "Access Denied", "Your session has timed out.", "The server took too long to respond.",
    "This website is under maintenance.", "Too Many Requests", "Unable to connect to the database.", "Please enable JavaScript to continue.", "JavaScript is required to use this site.",
    "This site requires JavaScript.", "Your browser does not support JavaScript.", "JavaScript must be enabled in order for you to use this page.",
    "We're sorry but app doesn't work properly without JavaScript enabled. Please enable it to continue.", "Please turn on JavaScript in your browser and reload the page.",
    "Enable JavaScript and cookies to continue", "It appears that JavaScript is disabled in your browser.", "You must have JavaScript enabled to use this form.",
    "Lorem ipsum dolor sit amet, consectetur", "sed do eiusmod tempor incididunt ut labore et dolore magna aliqua", "This is placeholder text.", "Coming soon",
    "This page is under construction.", "Your text here", "Add your text here", "Click here to edit this text.", "qwerty asdf zxcv qwerty", "blah blah blah blah blah blah",
    "This is a sample paragraph.", "Sample text.", "Insert your text here",
]
OTHER_FINE = [
    "The river was gone, and the page was not found by the team until 1990.", "We could not find the site of the lesion.", "Patients who could not be found were excluded.",
    "Access to care was denied.", "The gene was not found in the database.", "The server room is down the hall.", "JavaScript is a language used for web pages.",
    "The patient requires scripts for her medicine.", "The record of the trial was removed by hand.", "In 404 patients not found eligible, we saw none.",
    "Error rates of 503 samples were low.", "Values in [mg/L] and <LOD> are shown.", "See [Smith 2010] and [Figure 1].", "if (a < b && c > d) then", "the set {a, b} and {x}",
    "R^{abc} and \\text{abc}", "5% of 10% is small", "The page was removed from the archive in 1990.", "The connection between diet and age exists.", "No connection exists between them.",
    "The system failed to respond to treatment.", "The resource is restricted to members by law.", "The author's account is not available in English.",
    "The site was not found to be infected.", "This entry does not exist in MeSH but in SNOMED.", "To continue the study, we allowed scripts.", "He said he was sorry, the server was slow.",
    "No such vessel exists in the lung.", "The app in the study requires no scripts.", "Its content is coming soon after the review of 2010.",
    "Write about the sample text in your own words.", "The application was denied and the service was down in May.",
]


@pytest.mark.parametrize("text", CASES)
def test_residue_is_found(text):
    assert any(residue_of(text).values())
    assert any(residue_of("The study ran well.\n\n" + text + " It went on.").values())


@pytest.mark.parametrize("text", FINE)
def test_real_content_is_kept(text):
    assert not any(residue_of(text).values())


def test_residue_of_other_makers():
    """Recall of at least 0.9 alone and inside a text, no false hit."""
    alone = sum(any(residue_of(t).values()) for t in OTHER_MAKERS)
    inside = sum(any(residue_of(f"The study ran well.\n{t}\nIt went on.").values()) for t in OTHER_MAKERS)
    assert min(alone, inside) >= 0.9 * len(OTHER_MAKERS)
    assert not [t for t in OTHER_FINE if any(residue_of(t).values())]
    assert not [t for t in OTHER_FINE if any(residue_of(f"The study ran well. {t} It went on.").values())]


def test_code_explains_its_own_placeholders_only():
    code = "Use a loop:\n```\n{% for x in items %}{{ x.title }} {{ x.author }} {{ x.date }}{% endfor %}\n```\n"
    assert not any(residue_of(code + "Here {{ x.title }} prints the title.").values())
    assert residue_of(code + "Dear {{ first_name }}, thank you.")["placeholders"] == 1
    assert not any(residue_of("Write `{{ name }}` to print a name. Then {{ name }} shows.").values())


@pytest.mark.parametrize("text", ["<pre>" * 40_000, "`" * 200_000, "{" * 300_000, "the requested term page " * 20_000, "__a" * 100_000, "xxx " * 100_000, "error in abc " * 30_000])
def test_residue_scan_is_linear(text):
    began = time.perf_counter()
    residue_of(text)
    assert time.perf_counter() - began < 20


def test_residue_operator(spark):
    rows = [(i, t) for i, t in enumerate(CASES[:5] + FINE)] + [(None, CASES[0]), (500, CASES[0]), (501, "word " * 50_000 + CASES[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("errors", F.lit("clash"))
    assert two(residue_documents(df)) == [(i,) for i in (0, 1, 2, 3, 4, 500, 501)]
    assert without_residue(df).count() == len(FINE) + 1
    assert residue(df).count() == len(rows) - 1 and residue(df.limit(0)).count() == 0
