"""The registered queries of the reference operators, by area."""

from quillon.plans import chat, corpus, evaluation, generation, integrity, logits, preferences, serving, training, verification

__all__ = ["chat", "corpus", "evaluation", "generation", "integrity", "logits", "preferences", "serving", "training", "verification"]
