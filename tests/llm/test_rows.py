"""Operators that answer row by row: language, quality, personal data, sharding, packing."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

from topicloom.llm import language, packing, pii, quality, sharding

PROSE = {
    "en": "the river runs past the old mill and then the children walk home with their bread and honey while rain falls on the roof",
    "fr": "la rivière passe devant le vieux moulin et puis les enfants rentrent chez eux avec du pain et du miel pendant que la pluie tombe",
    "de": "der fluss fließt an der alten mühle vorbei und dann gehen die kinder mit brot und honig nach hause während regen auf das dach fällt",
}


def shuffled(lang: str, n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE[lang].split()) for _ in range(n))


# ---- language

def test_language_held_out(make_docs):
    labelled = [(i, shuffled(lang, 60, i), lang) for i, lang in enumerate(list(PROSE) * 20)]
    model = language.train_filter(make_docs(labelled))
    fresh = [(i, shuffled(lang, 25, 1000 + i), lang) for i, lang in enumerate(list(PROSE) * 10)]
    got = {r.doc_id: r for r in language.identify(make_docs(fresh), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in fresh)


def test_language_edge_cases(make_docs, spark):
    docs = make_docs([(1, PROSE["en"], "en"), (2, PROSE["fr"], "fr"), (3, PROSE["fr"], None), (None, PROSE["en"], "en"), (4, None, "en")], {"score": 1, "lang_pred": "x"})
    model = language.train_filter(docs)
    asked = make_docs([(1, None), (2, ""), (3, "12 !! 34"), (4, "日本"), (None, PROSE["en"]), (5, "é" * 200_000), (5, PROSE["fr"]), (5, PROSE["fr"])])
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in language.identify(asked, model).collect())
    assert got == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", False), (0, "en", True), (5, "en", False), (5, "fr", True), (5, "fr", True)])
    assert language.keep_identified(asked, model).columns == asked.columns
    assert language.keep_identified(asked, model).count() == 3
    empty = language.train_filter(asked.limit(0))
    assert {r.lang_pred for r in language.identify(asked, empty).collect()} == {"und"}


def test_filter_masks_have_no_false_negatives(make_docs):
    import numpy as np
    model = language.train_filter(make_docs([(1, PROSE["en"], "en"), (2, PROSE["de"], "de")]), language.FilterRules(relative_share=0.0))
    for i, lang in enumerate(model.languages):
        _, _, counts, _ = next(language.trigrams([PROSE[lang]]))
        total, hits = language.popcounts([PROSE[lang]], model)
        assert total[0] == counts[0] == hits[0, i]
    assert (model.rates < 0.01).all() and np.all(model.rates > 0)


def plain_sets(labelled, rules):
    """Trigram counts, sets and covered shares of each language, with plain dictionaries."""
    counts = {}
    for _, text, lang in labelled:
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for i in range(1, len(padded) - 1):
            if padded[i] != " ":
                of = counts.setdefault(lang, {})
                of[padded[i - 1:i + 2]] = of.get(padded[i - 1:i + 2], 0) + 1
    sets = {}
    for lang, of in counts.items():
        total, least = sum(of.values()), 1
        while sum(n for n in of.values() if n >= 2 * least) >= rules.covered * total:
            least *= 2
        share = lambda t, x: counts[x].get(t, 0) / sum(counts[x].values())
        sets[lang] = {t for t, n in of.items() if n >= least and share(t, lang) >= rules.relative_share * max(share(t, x) for x in counts)}
    return counts, sets


def test_language_decides_as_exact_sets_do(make_docs):
    """With slots to spare the filter answers as sets of trigrams would."""
    rules = language.FilterRules(covered=0.9, slots_per_entry=4096)
    labelled = [(i, PROSE[lang], lang) for i, lang in enumerate(sorted(PROSE))]
    counts, sets = plain_sets(labelled, rules)
    model = language.train_filter(make_docs(labelled), rules)
    assert all(own == pytest.approx(sum(n for t, n in counts[x].items() if t in sets[x]) / sum(counts[x].values())) for x, own in zip(model.languages, model.own))
    asked = [" ".join(PROSE[lang].split()[i:i + 4]) for lang in sorted(PROSE) for i in range(0, 24, 2)]
    names, scores, _ = language.decide(asked, model)
    for text, name, score in zip(asked, names, scores):
        own = plain_sets([(0, text, "x")], rules)[0]["x"]
        exact = {x: sum(n for t, n in own.items() if t in sets[x]) / sum(own.values()) for x in model.languages}
        assert score == pytest.approx(max(exact.values()), abs=0.02) and exact[name] >= max(exact.values()) - 0.02


def test_large_alphabet_keeps_its_text(make_docs):
    """Thousands of letters: no trigram is frequent, the text is covered all the same and clean documents stay."""
    rng = random.Random(3)
    words = ["".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(2)) for _ in range(3000)]
    texts = ["".join(words[min(2999, int(rng.paretovariate(0.6)))] for _ in range(400)) for _ in range(150)]
    rows = [(i, t, "zh") for i, t in enumerate(texts[:100])] + [(1000 + i, PROSE[x], x) for i, x in enumerate(sorted(PROSE))]
    fresh = make_docs([(2000 + i, t, None) for i, t in enumerate(texts[100:])])
    model = language.train_filter(make_docs(rows))
    assert model.own[model.languages.index("zh")] >= 0.99
    assert {r.lang_pred for r in language.identify(fresh, model).collect()} == {"zh"}
    assert language.keep_identified(fresh, model).count() == 50
    tight = language.train_filter(make_docs(rows), language.FilterRules(slot_bits=14))
    assert tight.words.shape[1] == 1 << 14 and tight.rates.max() > 0.1
    assert {r.lang_pred for r in language.identify(fresh, tight).collect()} == {"zh"}


def test_ties_and_a_very_long_text(make_docs):
    same = language.train_filter(make_docs([(1, PROSE["en"], "b"), (2, PROSE["en"], "a")]))
    long = PROSE["en"] + " " + "word " * 300_000
    got = {r.doc_id: r for r in language.identify(make_docs([(1, PROSE["en"], None), (2, long, None)]), same).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "a" and got[2].n_trigrams > 1_200_000


def test_many_languages_use_more_words(make_docs):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)} " * 5, f"l{i:03d}") for i in range(70)]
    model = language.train_filter(make_docs(rows))
    assert model.words.shape[0] == 2
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in language.identify(make_docs(rows), model).collect())


# ---- quality

def plain_repeated(words, size=3):
    windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(size)})


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words_against_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 14))] + [str(rng.randint(0, 9)).encode() for _ in range(20)]
    assert quality.repeated_words(words) == plain_repeated(words)


SENTENCE = "The quick grey heron waits beside the water until small fish come near enough to catch."


def test_line_rules():
    rules = quality.LineRules()
    fails = lambda line: quality.line_fails(line, line.split(), rules)
    assert not fails(SENTENCE) and not fails(SENTENCE + "\r") and not fails(f"“{SENTENCE}”")
    assert fails("Home | About | Contact | Help.") and fails("All rights reserved.") and fails("A heading without an end")
    assert fails("word### other&&& third$$$ fourth%%%.") and fails("BUY!! THIS!! NOW!! IT!! IS!! GREAT!!")
    assert not fails("これは文です。") and not fails(" ".join(["word"] * 30))


def test_quality_edge_cases(make_docs):
    lines = "\n".join(" ".join(f"w{i}x{j}" for j in range(17)) + "." for i in range(5))
    docs = make_docs([(1, None), (2, ""), (3, lines), (4, lines + "\nAll rights reserved."), (None, lines), (3, lines), (5, " \n\t ")], {"kept": 1, "n_words": 2})
    got = {(r.doc_id, r.n_words): r for r in quality.line_quality(docs).collect()}
    assert not got[1, 0].kept and got[1, 0].base_failed and got[5, 0].word_chars == 0
    assert got[3, 85].kept and got[4, 88].kept and got[4, 88].lines_removed == 1 and got[4, 88].clean_text == lines
    kept = quality.clean_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3, 4]
    assert quality.line_quality(docs.limit(0)).count() == 0


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    spans = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


@pytest.mark.parametrize("seed", range(60))
def test_base_spans_against_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["a@b.co", "x.y+z@h-1.example.org", "@", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "4539 1488 0343 6467", "4539148803436467", "+1 (555) 123-4567", "+12", ".", " ", "-", "é", "9"]
    text = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(30))
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []
    assert pii.base_spans("7" * 200_000 + ".1.1.1") == []


def pii_corpus():
    secret = [(i, f"the harbour master Quillfeather wrote to q.feather@port.example.org about the berth number {i} today") for i in range(5)]
    plain = [(100 + i, f"the harbour was calm and the people wrote about the weather number {i} today in the town") for i in range(60)]
    return secret + plain


def test_disclosing_terms_are_found(make_docs):
    docs = make_docs(pii_corpus(), {"terms": 1, "spans": "x", "_row": 3})
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    text = dict(pii_corpus())[0]
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in found[0].spans.split(","))]
    terms = {text[a:b].lower() for k, a, b in spans if k == "term"}
    assert "quillfeather" in terms and "master" in terms and not terms & {"the", "harbour", "wrote", "number"}
    assert found[0].n_email == 1 and all(found[100 + i].spans == "" for i in range(60))
    assert found[0].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k == "email").encode()).hexdigest()
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "[EMAIL]" in texts[0] and "Quillfeather" not in texts[0] and "harbour" in texts[0] and texts[100] == dict(pii_corpus())[100]


def plain_disclosure(rows, limits):
    """(entity, term) -> disclosure of all pairs that stand in one document, from whole texts."""
    import math
    with_entities, with_terms, pairs = Counter(), Counter(), Counter()
    for _, text in rows:
        spans = plain_spans(text)
        entities = {pii.entity_of(text, s) for s in spans}
        terms = {m.group().lower() for m in re.finditer(r"\w+", text) if not any(m.start() < e and s < m.end() for s, _, e in spans)}
        with_terms.update({m.group() for m in re.finditer(r"\w+", text.lower())})
        with_entities.update(entities)
        pairs.update(itertools.product(entities, terms))
    found = {}
    for (e, t), n in pairs.items():
        content = math.log(len(rows) / with_entities[e])
        value = math.log(n * len(rows) / (with_entities[e] * with_terms[t])) / content * n / (n + limits.prior) if content else 0.0
        if value >= limits.disclosure:
            found[e, t] = value
    return found


@pytest.mark.parametrize("seed, limits", [(1, pii.Disclosure()), (2, pii.Disclosure(prior=0.0)), (3, pii.Disclosure(disclosure=0.5, prior=1.0))])
def test_disclosure_against_brute_force(make_docs, seed, limits):
    """Long texts, several entities in a document, names of two letters."""
    rng = random.Random(seed)
    words = [f"w{min(400, int(rng.paretovariate(0.4)))}" for _ in range(6000)] + ["Li", "Wu", "x"] * 20
    people = [("Li Quill", "li.q@port.example.org"), ("Wu Marsh", "+1 555 123 4567 89"), ("Anna Reed", "10.0.0.7")]
    rows = []
    for i in range(90):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 400]))]
        for name, entity in rng.sample(people, rng.choice([0, 0, 0, 1, 2])):
            text.insert(rng.randrange(len(text)), name)
            text.insert(rng.randrange(len(text)), entity)
        rows.append((i, " ".join(text)))
    rows += [(100, "once a@b.co Zed"), (101, "once " + "w1 " * 30)]
    docs = make_docs(rows)
    found = pii.materialise(pii.find_entities(docs, limits, "doc_id", "text"), "t")
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosed_terms(docs, found, limits).collect()}
    want = plain_disclosure(rows, limits)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {"quill", "zed"} <= {t for _, t in want} if limits.disclosure == 0.8 else want


def test_page_of_many_addresses_meets_its_terms_in_parts(make_docs):
    page = "Directory " + " ".join(f"user{i}@port.example.org name{i}" for i in range(600))
    rows = [(0, page)] + [(1 + i, "the harbour was calm") for i in range(40)]
    limits = pii.Disclosure()
    found = pii.materialise(pii.find_entities(make_docs(rows), limits, "doc_id", "text"), "t")
    got = pii.disclosed_terms(make_docs(rows), found, limits)
    assert got.count() == 600 * 601 == got.distinct().count()


def test_meetings_decide_between_generalising_and_removing(make_docs):
    plain = [(100 + i, "the harbour was calm") for i in range(60)]
    for copies, gone in ((1, False), (3, True)):
        rows = [(i, "the harbour was Quillfeather q@port.example.org calm") for i in range(copies)] + plain
        text = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}[0]
        assert text == ("the harbour was  [EMAIL] calm" if gone else "the harbour was [NAME] [EMAIL] calm")


def test_entity_of_one_document_has_terms(make_docs):
    rows = [(0, "the harbour master Quillfeather wrote to q.feather@port.example.org about the weather")] + pii_corpus()[5:]
    docs = make_docs(rows)
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert found[0].n_term == 3 and all(found[i].n_term == 0 for i, _ in rows[1:])
    assert {r.text for r in pii.sanitise(docs).where("doc_id = 0").collect()} == {"the harbour [WORD] [NAME] wrote [WORD] [EMAIL] about the weather"}


def test_terms_far_from_the_entity_are_found_everywhere(make_docs):
    filler = "the harbour was calm and the people wrote about the weather today in the town " * 4
    letter = f"Quillfeather {filler}Quillfeather mailed q.feather@port.example.org {filler}quillfeather"
    rows = [(0, letter), (1, letter), (2, f"{filler}q.feather@port.example.org and b@c.org")] + [(100 + i, filler) for i in range(60)]
    docs = make_docs(rows)
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    words = lambda i: [rows[i][1][int(a):int(b)].lower() for k, a, b in (s.split(":") for s in found[i].spans.split(",")) if k == "term"]
    assert words(0) == words(1) == ["quillfeather", "quillfeather", "mailed", "quillfeather"] and words(2) == [] and found[0].n_term == 4
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "quillfeather" not in clean[0].lower() and "harbour" in clean[0] and clean[100] == filler


def test_pii_edge_cases(make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "mail a@b.co"), (3, "mail a@b.co"), (3, "mail a@b.co"), (4, "x" * 100_000 + " a@b.co")])
    got = sorted((r.doc_id or 0, r.spans) for r in pii.find_spans(docs, pii.Disclosure(min_support=4)).collect())
    assert got == [(0, "email:5:11"), (1, ""), (2, ""), (3, "email:5:11"), (3, "email:5:11"), (4, "email:100001:100007")]
    assert pii.sanitise(docs).count() == 6 and pii.find_spans(docs.limit(0)).count() == 0


# ---- sharding and packing

def test_shards_are_balanced_and_gapless(make_docs):
    rng = random.Random(3)
    rows = [(i, "w" * rng.randint(0, 300)) for i in range(500)] + [(1000 + i, "same text") for i in range(300)] + [(None, None)] * 40 + [(7, "twice")] * 30
    got = sharding.shard_by_bytes(make_docs(rows, {"shard": 5, "part": 1}), 8).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 16) for i, t in rows)
    by = {k: sorted(v, key=lambda r: r.slot) for k, v in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard)}
    assert all([r.slot for r in v] == list(range(len(v))) for v in by.values()) and list(by) == list(range(8))
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 316
    order = [r.text_crc32 for v in by.values() for r in v]
    assert order == sorted(order)
    assert sharding.shard_by_bytes(make_docs(rows).limit(0), 8).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 9)))
    histogram = [(x, rng.randint(1, 9), 0) for x in lengths]
    histogram = [(x, n, x * n) for x, n, _ in histogram]
    buckets = rng.randint(1, 5)

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n, _ in histogram)

    got = packing.optimal_boundaries(histogram, buckets)
    best = min(padding((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], min(buckets, len(lengths)) - 1))
    assert got[-1] == lengths[-1] and len(got) <= buckets and padding(got) == best


def test_batches_keep_the_budget(make_docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 3, 3, 3, 20, 40])) for i in range(300)] + [(None, None)] * 20 + [(9, "w " * 5000)]
    got = packing.pack(make_docs(rows, {"bucket": 1, "rank": 2}), buckets=3, token_budget=100).collect()
    assert len(got) == len(rows)
    batches = Counter((r.bucket, r.batch) for r in got)
    width = {r.bucket: r.padded_to for r in got}
    assert all(n * width[b] <= 100 or n == 1 or width[b] == 0 for (b, _), n in batches.items())
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    for b in width:
        sizes = [n for (x, _), n in sorted(batches.items()) if x == b]
        assert all(n == sizes[0] for n in sizes[:-1])
    assert packing.pack(make_docs(rows).limit(0)).count() == 0
