"""Query of SentencePiece encoding and decoding over all documents."""

from __future__ import annotations

from geosieve.llm.pieces import round_trip
from geosieve.llm.tables import read


def op10_sentencepiece(spark, folder):
    return round_trip(read(spark, folder, "documents"))


# Viterbi has no SQL; it is tested against brute force and by the exact round trip.
QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
