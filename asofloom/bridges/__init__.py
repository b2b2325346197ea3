"""Columns that no aggregation or window can express, computed before the matrix and joined to it as one more entity."""

from .base import Bridge, assert_known, assert_vintage, known_rows
from .graphs import Centrality, Community, PageRank
from .series import ChangePoint, EmbeddingTrajectory, MarkovSurprisal, Periodicity
from .texts import CoMentionEdges, LanguageId, NearDuplicateEdges, NERCounts, Readability, SentenceEmbedding, Sentiment, TfidfTopicShare

__all__ = [
    "Bridge",
    "Centrality",
    "ChangePoint",
    "CoMentionEdges",
    "Community",
    "EmbeddingTrajectory",
    "LanguageId",
    "MarkovSurprisal",
    "NERCounts",
    "NearDuplicateEdges",
    "PageRank",
    "Periodicity",
    "Readability",
    "SentenceEmbedding",
    "Sentiment",
    "TfidfTopicShare",
    "assert_known",
    "assert_vintage",
    "known_rows",
]
