"""Settings shared by the queries and their SQL."""

from __future__ import annotations

from dataclasses import dataclass

# Frequent English function words, standing in for the user's stopword file.
STOPWORDS = (
    "a about after all also an and any are as at be because been before but by can could did do does each "
    "for from had has have he her here him his how i if in into is it its just like made many may me more "
    "most my no not now of on one only or other our out over said same she should so some such than that "
    "the their them then there these they this those through to too under up us was we well were what when "
    "where which while who will with would you your"
).split()


@dataclass(frozen=True)
class Settings:
    min_support: float = 0.1
    min_distance: float = 0.5
    connected_edges: int = 3
    word_budget: int = 100
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    one_topic: str = "de"
