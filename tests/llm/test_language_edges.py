"""Language ID against a plain loop over zstandard, and its odd rows."""

import math
import random

import zstandard

from voxelgate.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tur", "en"], "bb": ["szcz", "przy", "wł", "ia", "ow"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, row string, lang_pred string").repartition(3)


def sample(rng):
    return [(i, prose(rng, lang, rng.randrange(1, 80)), lang) for i in range(120) for lang in [rng.choice(["aa", "bb"])]]


def by_hand(model, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    raw = b" " + b" ".join(text.lower().encode().translate(langid._SPACES).split()) + b" "
    sizes = {}
    for lang, content in sorted(model.dictionaries.items()):
        known = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[lang] = 0
        for at in range(0, len(raw), langid._BLOCK):
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] += len(coder.compress(raw[at : at + langid._BLOCK]))
    first, *rest = sorted(sizes, key=lambda k: (sizes[k], k))
    score = 1 / sum(math.exp(-min(700.0, (s - sizes[first]) / langid._SOFTNESS)) for s in sizes.values())
    return first, score, bool(rest) and sizes[rest[0]] - sizes[first] < max(model.min_margin * sizes[first], model.min_bytes)


def test_predictions_are_those_of_a_plain_loop(spark):
    rng = random.Random(6)
    rows = sample(rng)
    model = langid.fit(table(spark, rows), dictionary_bytes=4096)
    asked = [(i, t, None) for i, t, _ in rows[:40]] + [(None, rows[0][1], "aa"), (None, None, None), (7, rows[7][1], None), (7, rows[7][1], None), (8, prose(rng, "bb", 60_000), None), (9, "²³ 12 !", None), (10, prose(rng, "aa", 30) + " " + prose(rng, "bb", 30), None)]
    got = sorted(((r.row.doc_id, r.row.text, r.lang_pred, round(r.score, 9), r.rejected) for r in langid.identify(table(spark, asked), model, carry=("doc_id", "text")).collect()), key=repr)
    want = []
    for i, t, _ in asked:
        lang, score, rejected = by_hand(model, t)
        want.append((i, t, lang, round(score, 9), rejected))
    assert got == sorted(want, key=repr)


def test_dictionaries_hold_whole_texts(spark):
    """Short texts first, no text cut, none beyond the bound; where nothing fits, the shortest alone."""
    rng = random.Random(7)
    rows = [(i, prose(rng, "aa", 12), "aa") for i in range(60)] + [(100 + i, prose(rng, "aa", 200), "aa") for i in range(9)] + [(200 + i, prose(rng, "bb", 2000 + i), "bb") for i in range(5)]
    model = langid.fit(table(spark, rows), dictionary_bytes=2000)
    plain = {langid.letters(t) for _, t, _ in rows}
    content = model.dictionaries["aa"]
    taken = [x for x in plain if x in content]
    assert len(content) <= 2000 and sum(map(len, taken)) + len(taken) - 1 == len(content) and len(taken) > 5
    assert model.dictionaries["bb"] == min((langid.letters(t) for i, t, k in rows if k == "bb"), key=len)
    assert langid.fit(table(spark, rows), docs_per_language=1).dictionaries["bb"] in plain


def test_repeated_rows_and_null_ids_teach(spark):
    rows = [(1, "kalo miturka", "aa")] * 3 + [(None, "szczow przyia", "bb")] * 2 + [(2, None, "aa"), (3, "und text", "und"), (4, "no language", None)]
    model = langid.fit(table(spark, rows))
    assert set(model.dictionaries) == {"aa", "bb"} and model.dictionaries["aa"].count(b"kalo") == 3


def test_a_tie_goes_to_the_first_language_and_is_rejected(spark):
    model = langid.LanguageModel({"bb": b"kalo miturka", "aa": b"kalo miturka"})
    (r,) = langid.identify(table(spark, [(1, "kalo miturka", None)]), model).collect()
    assert (r.lang_pred, r.rejected) == ("aa", True) and abs(r.score - 0.5) < 1e-9
