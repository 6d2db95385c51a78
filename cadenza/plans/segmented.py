"""Queries of the word operators that cut long videos into chunks; their SQL is that of the uncut ones."""

from ..operators import segmented as G
from ..sources import tables as T
from . import words as P
from .registry import ORACLE, query

#: Positions of a chunk: texts of some hundred words are cut several times.
SIZE = 40


@query("n14_word_ends_cut", ORACLE["n14_word_ends"])
def n14(spark, sf_dir):
    return G.word_ends(P.mixed(spark, sf_dir), SIZE).select("vid", "seq", "end_ms")


@query("n15_speech_gaps_cut", ORACLE["n15_speech_gaps"])
def n15(spark, sf_dir):
    return G.speech_gaps(P.mixed(spark, sf_dir), SIZE).select("vid", "seq", "gap_ms")


@query("n19_groups_cut", ORACLE["n19_groups"])
def n19(spark, sf_dir):
    return G.sessions(P.mixed(spark, sf_dir), size=SIZE).select("vid", "seq", "segment")


@query("n21_without_echoes_cut", ORACLE["n21_without_echoes"])
def n21(spark, sf_dir):
    return G.without_echoes(P.echo(spark, sf_dir), SIZE).select("vid", "seq", "text", "t_ms", "end_ms")


@query("j1_word_speakers_cut", ORACLE["j1_word_speakers"])
def j1(spark, sf_dir):
    late = P.timed(spark, sf_dir).selectExpr("vid", "seq", "text", "t_ms + 170 AS t_ms", "end_ms + 170 AS end_ms")
    return G.word_speakers(late, T.turns(spark, sf_dir), SIZE).select("vid", "seq", "spk")
