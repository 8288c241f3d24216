"""Word lists used by the built-in rules. Every list is a parameter of the operator using it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Lexicon = Mapping[str, Sequence[str]]

# Words that need their surroundings to be understood: demonstrative, indefinite, relative,
# interrogative and reflexive pronouns and pronominal adverbs. Personal and possessive pronouns
# are not among them.
AMBIGUOUS_WORDS: Lexicon = {
    "de": (
        "dies dieser diese dieses diesem diesen jener jene jenes jenem jenen derselbe dieselbe dasselbe "
        "solche solcher solches solchen man jemand niemand etwas nichts einige manche mehrere alles alle jeder jede jedes "
        "sich einander wer wen wem wessen was welche welcher welches welchen welchem "
        "dabei dadurch dafür dagegen daher damit danach daneben daran darauf daraus darin darüber darum darunter davon davor dazu "
        "hierbei hierfür hiermit hierzu wobei wodurch wofür womit woran worauf woraus worüber wovon wozu"
    ).split(),
    "en": (
        "this that these those who whom whose which what someone somebody something anyone anybody anything "
        "everyone everybody everything nobody nothing none each other another such some "
        "myself yourself himself herself itself ourselves themselves thereby therefore therein thereof hereby herein"
    ).split(),
    "fr": (
        "ce ceci cela ça celui celle ceux celles qui que quoi dont lequel laquelle lesquels lesquelles auquel duquel "
        "se on quelqu quelques chacun chacune personne rien tout tous certains plusieurs tel telle y en"
    ).split(),
    "es": (
        "esto este esta estos estas eso ese esa esos esas aquello aquel aquella aquellos aquellas "
        "que quien quienes cual cuales cuyo se alguien algo nadie nada alguno alguna algunos ninguno todo todos otro otra"
    ).split(),
}

# Cue words of the built-in stance rule: (pro, contra) per language.
PRO_CUES: Lexicon = {
    "de": "für befürworten befürwortet unterstützen unterstützt zustimmen zustimmung ja sinnvoll notwendig wichtig vorteil stärkt".split(),
    "en": "for support supports favor favour agree agrees yes useful necessary important benefit strengthens".split(),
    "fr": "pour soutenir soutient favorable accepter oui utile nécessaire important avantage renforce".split(),
    "es": "para apoyar apoya favorable aceptar sí útil necesario importante ventaja refuerza".split(),
}
CONTRA_CUES: Lexicon = {
    "de": "gegen ablehnen ablehnt nein nicht kein keine unnötig schädlich nachteil schwächt warnt".split(),
    "en": "against oppose opposes reject rejects no not never unnecessary harmful drawback weakens warns".split(),
    "fr": "contre opposer refuse rejeter non pas jamais inutile nuisible inconvénient affaiblit".split(),
    "es": "contra oponer rechaza rechazar no nunca innecesario dañino desventaja debilita".split(),
}


def in_lexicon(lexicon: Lexicon, lang: Column, word: Column) -> Column:
    """Whether a lower-cased word is listed for the row's language, or for any where it is unknown.

    A list of constants is looked up as a hash set.
    """
    out = F
    for code, entries in lexicon.items():
        out = out.when(lang == code, word.isin(*entries))
    return out.otherwise(word.isin(*sorted({w for entries in lexicon.values() for w in entries})))
