"""Porter stemmer on the published examples; stemmed ROUGE tokens."""

from quire.functions.stem import porter_stem, stem_tokens
from quire.functions.text import rouge_tokens

PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform",
    "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "generalizations": "gener", "oscillators": "oscil",
}


def test_published_examples():
    bad = {w: (porter_stem(w), s) for w, s in PUBLISHED.items() if porter_stem(w) != s}
    assert not bad


def test_stem_arrays(spark):
    df = spark.createDataFrame([("The cats were running quickly, ties!",)], "t string")
    got = df.select(stem_tokens(rouge_tokens("t")).alias("s")).first().s
    assert got == ["the", "cat", "were", "run", "quickli", "ti"]


def test_stemmed_rouge_merges_inflections(spark):
    from quire.functions.stem import stemmed_rouge_tokens
    from quire.operators.evaluate import rouge_n
    df = spark.createDataFrame([(1, "cats running", "cat runs")], "k int, candidate string, reference string")
    plain = rouge_n(df, ["k"], 1).first()
    stem = rouge_n(df, ["k"], 1, tokens=stemmed_rouge_tokens).first()
    assert plain.rouge1_f == 0.0 and stem.rouge1_f == 1.0
