"""Word lists of the English segmentation rules, and the protected word pairs.

The lists are fixed values: results depend on exactly these words. The protected pairs are a parameter
(a table w1, w2 of any size); `default_pairs` builds a small own one from a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values ------------------------------------------------------------------------------------

#: Words that may begin a clause after a comma or a conjunction.
CLAUSE_STARTERS = """
i you he she it we they
this that these those there
and but or so nor yet for
if when because although since unless though while where whereas as once until
which who whom whose what how why whether
""".split()

#: Words that begin an elaboration after a comma; never list items.
ELABORATION_STARTERS = """
very similar much more
especially particularly including such like notably namely
mostly mainly primarily largely typically generally
depending based compared according excluding except related
essentially specifically
""".split()

#: Subjects that begin a clause right after a comma.
CLAUSE_SUBJECTS = "i you he she it we they this that these those there".split()

#: Conjunctions that join clauses, and words that subordinate one.
CONJUNCTIONS = "and but or so".split()
SUBORDINATORS = "because although since unless while when where if as".split()

#: Words after "so" that make it mean "very".
SO_INTENSIFIED = """
much many little few
good bad big small long short high low fast slow hard soft loud quiet
bright dark wide deep hot cold warm cool great huge tiny vast large
easy simple clear clean smooth rough early late soon far close near often
right wrong true sure certain new old young fresh strong weak nice kind weird strange happy sad calm
best worst most least biggest smallest greatest largest highest fastest slowest loudest quietest easiest
better worse greater larger smaller higher lower faster slower earlier later more less
""".split()
SO_SUFFIXES = "ful less ous ive able ible ic ical esque like some ish".split()

#: Words after which a cue should not end.
FRAGILE = """
the a an this that these those same my your his her its our their
will would can could shall should may might must
is am are was were been being have has had do does did
in on at for with by from of about to into through during without between under over before after above below
upon onto against among beside beneath underneath around behind along across toward towards throughout
inside outside via per near despite within unlike versus
if when while because although since unless though whereas how as once until
which who whom whose where and but or so nor yet
just almost nearly really barely hardly merely simply quite virtually essentially practically roughly approximately
already also still going no not even too very rather only
some any many much more most few several each every both all such
""".split()

#: Names of languages and the codes that mark output files.
LANGUAGES = {
    "chinese": "CN", "english": "EN", "japanese": "JP", "korean": "KR", "french": "FR", "german": "DE", "spanish": "ES",
    "italian": "IT", "portuguese": "PT", "russian": "RU", "arabic": "AR", "hindi": "HI", "thai": "TH", "vietnamese": "VN",
    "dutch": "NL", "polish": "PL", "turkish": "TR", "indonesian": "ID", "malay": "MS", "swedish": "SV", "norwegian": "NO",
    "danish": "DA", "finnish": "FI", "greek": "EL", "hebrew": "HE", "romanian": "RO", "czech": "CS", "hungarian": "HU", "ukrainian": "UK",
}
#: Languages with full-width punctuation.
FULLWIDTH = "chinese mandarin cantonese japanese korean".split()

# -------------------------------------------------------------------------------------------------

def default_pairs() -> list[tuple[str, str]]:
    """A small list of protected pairs by rule: particle verbs, fixed openings and degree phrases."""
    particles = {"look": "at up into for", "carry": "on out", "set": "up out off", "pick": "up out", "turn": "on off into", "find": "out", "give": "up back"}
    pairs = {(verb, p) for verb, ps in particles.items() for p in ps.split()}
    pairs |= {(a, "of") for a in "kind sort lot bit couple number amount instead because front".split()}
    pairs |= {("such", "as"), ("as", "well"), ("so", "that"), ("just", "so"), ("in", "order"), ("at", "least"), ("for", "example"), ("of", "course"), ("each", "other")}
    return sorted(pairs)


def pairs_table(spark: SparkSession, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """The protected pairs as a table (w1, w2)."""
    return spark.createDataFrame(default_pairs() if pairs is None else pairs, "w1 string, w2 string")
