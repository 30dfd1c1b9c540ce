"""Fitted cleaning and trained models on streams."""

from gridwright.streaming.clean import FittedCleaning
from gridwright.streaming.score import StreamScorer

__all__ = ["FittedCleaning", "StreamScorer"]
