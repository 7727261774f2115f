import random

from folioforge.functions.stem import lexemes, stem
from folioforge.operators import lexical

# words and stems of the stemmer's published sample vocabulary
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave
knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew
knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


def test_stems_of_the_published_sample():
    assert {w: stem(w) for w in SAMPLE[::2]} == dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))


def test_rules_one_by_one():
    pairs = {
        "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "caresses": "caress",
        "agreed": "agre", "feed": "feed", "hopping": "hop", "hoping": "hope", "hoped": "hope", "luxuriated": "luxuri", "by": "by", "say": "say", "cry": "cri", "enjoyed": "enjoy", "youth": "youth",
        "generate": "generat", "general": "general", "generously": "generous", "communism": "communism", "community": "communiti", "arsenal": "arsenal",
        "relational": "relat", "rational": "ration", "analogies": "analog", "hopefully": "hope", "relentlessly": "relentless", "radically": "radic", "happiness": "happi", "formative": "format", "replacement": "replac", "adoption": "adopt", "rolling": "roll", "controlling": "control", "rate": "rate", "parable": "parabl",
        "dying": "die", "news": "news", "inning": "inning", "innings": "inning", "proceeds": "proceed", "exceeding": "exceed",
        "résumés": "résumé", "naïvely": "naïv", "ß": "ß", "2024s": "2024s", "sss": "sss", "yyy": "yyy", "sayyid": "sayyid", "yes": "yes",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_lexemes_keep_accents_and_drop_stop_words():
    assert lexemes("The Élan of ourselves, naïve_running: 3 Übungen") == ["élan", "naïv", "run", "3", "übungen"]
    assert lexemes(None) == lexemes("themselves yours") == []


def test_a_stem_begins_as_its_word():
    """So words that begin otherwise than a question's stems needn't be stemmed."""
    rng = random.Random(3)
    made = ["".join(rng.choice("aeiouystinged'rlcéz") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    made += [b + e for b in ("", "a", "y", "sk", "xy") for e in ("ing", "ied", "ies", "eed", "eedly", "sses", "ational", "li", "ement", "ion")]
    assert all(stem(w)[:1] == w[:1] for w in made if w)


def test_postings_of_a_question(spark):
    """Those of its lexemes alone, at the same places among all lexemes."""
    question, texts = "the things, thinning", ["Things are thin; a thing!", "other words and stones", None, "thinned things of thought", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole, some = lexical.postings(docs), lexical.postings(docs, question=question)
    wanted = set(lexemes(question))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(some) == [r for r in rows(whole) if r[0] in wanted] and len(rows(some)) == 4
    assert rows(lexical.postings(docs, question="the of")) == []
