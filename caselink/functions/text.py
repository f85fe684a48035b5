"""Tokens of a free-text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English list that pyspark.ml.feature.StopWordsRemover ships.
# Entries with an apostrophe never match a token, which is a run of word characters;
# they stay so that the list equals its source.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
    they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
    wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
    """.split()
)

TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"


def text_or_empty(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def text_id(text: Column | str) -> Column:
    """Key of a text: 16 bytes, so that distinct texts stay apart at any table size."""
    return F.unhex(F.md5(text_or_empty(text)))


def text_key(text: Column | str) -> Column:
    """What can stand for a text in ``mo_text`` where it is only compared: equal, empty and null as the text is."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(column == "", "").otherwise(F.md5(column))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters, repeats kept."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TOKEN_PATTERN), F.lit(1))


def is_term(token: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    return ~token.isin(list(stop_words)) if stop_words else F.lit(True)
