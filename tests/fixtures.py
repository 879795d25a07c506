"""Seeded generators shaped like the inputs the tool is used on."""

from __future__ import annotations

import numpy as np

TOPIC_WORDS = [
    "glacier summit ridge avalanche rope crampon icefall basecamp".split(),
    "violin cello sonata tempo chord rehearsal".split(),
    "sourdough yeast oven crust flour knead proofing".split(),
    "orbit thruster telescope nebula probe".split(),
    "loom weave yarn indigo spindle warp felt".split(),
    "lagoon reef tide kelp anemone heron".split(),
]
NOISE = "a then some about yet".split()


def documents(n: int, topics: int = 5, seed: int = 7) -> list[tuple[int, str, int]]:
    """(doc_id, text, true_topic): three to seven topic words and two noise words."""
    rng = np.random.default_rng(seed)
    result = []
    for i in range(n):
        topic = i % topics
        words = list(rng.choice(TOPIC_WORDS[topic], rng.integers(3, 8))) + list(rng.choice(NOISE, 2))
        result.append((i, " ".join(words), topic))
    return result


def blobs(groups: int = 4, size: int = 40, noise: int = 20, dim: int = 8, seed: int = 0) -> list[tuple[int, list[float], int]]:
    """(doc_id, embedding, true group): well separated groups and scattered points (-1)."""
    rng = np.random.default_rng(seed)
    points = []
    for g in range(groups):
        center = rng.normal(size=dim) * 8
        points += [(center + rng.normal(size=dim), g) for _ in range(size)]
    points += [(rng.uniform(-20, 20, dim), -1) for _ in range(noise)]
    return [(i, [float(x) for x in p], g) for i, (p, g) in enumerate(points)]
