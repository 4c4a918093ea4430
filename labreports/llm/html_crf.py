"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each block of a page is article or not. Its features are the tags and names above it, its own tag
and its text; neighbouring labels depend on each other. The weights are trained on labelled pages
and the best labels of a whole page are decoded by the Viterbi algorithm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from labreports.llm.common import add_columns
from labreports.llm.html_blocks import Block, leaf_blocks
from labreports.llm.html_examples import labelled_page


def block_features(block: Block) -> frozenset[str]:
    """Names of the binary features of one block."""
    words = block.text.count(" ") + 1
    last = block.text[-1]
    share = block.linked / len(block.text)
    size = "1" if words == 1 else "2-4" if words < 5 else "5-11" if words < 12 else "12-29" if words < 30 else "30+"
    own = {
        f"tag={block.tag}",
        f"words={size}",
        f"linked={'none' if share == 0 else 'part' if share < 0.6 else 'most'}",
        "ends" if last in ".!?…:;\"”»" else "open",
        "bias",
    }
    if "©" in block.text or "(c)" in block.text.lower():
        own.add("copyright")
    return block.above.union(block.near, own)


@dataclass(frozen=True)
class BlockModel:
    """Weights of a feature for the label article (its negative stands for the other label), and
    scores of label after label; label 1 is article."""

    weights: dict[str, float]
    steps: np.ndarray  # 2 x 2
    start: np.ndarray  # 2

    def decode(self, scores: list[float]) -> list[bool]:
        """Labels of the best path; ties go to article."""
        if not scores:
            return []
        (nn, ny), (yn, yy) = self.steps.tolist()
        no, yes = self.start[0] - scores[0], self.start[1] + scores[0]
        back = []
        for score in scores[1:]:
            from_no, from_yes = no + ny > yes + yy, no + nn > yes + yn
            back.append((from_yes, from_no))
            no, yes = max(no + nn, yes + yn) - score, max(no + ny, yes + yy) + score
        label = yes >= no
        labels = [label]
        for no_from_no, yes_from_no in reversed(back):
            label = not (yes_from_no if label else no_from_no)
            labels.append(label)
        return labels[::-1]


def _gradient(x, y, present, weights, steps, start):
    """Gradient of the log-likelihood of all pages at once; ``x`` is pages x blocks x features."""
    unary = x @ weights
    score = np.stack([-unary, unary], -1)
    pages, length = unary.shape
    alpha, beta = np.zeros((pages, length, 2)), np.zeros((pages, length, 2))
    alpha[:, 0] = start + score[:, 0]
    for t in range(1, length):
        moved = np.logaddexp.reduce(alpha[:, t - 1, :, None] + steps, 1) + score[:, t]
        alpha[:, t] = np.where(present[:, t, None], moved, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        moved = np.logaddexp.reduce(steps + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(present[:, t + 1, None], moved, 0)
    total = np.logaddexp.reduce(alpha[:, -1], 1)
    chance = np.exp(alpha + beta - total[:, None, None]) * present[..., None]
    truth = np.stack([~y, y], -1) * present[..., None]
    gap = truth - chance
    both = present[:, 1:]
    pair = np.exp(
        alpha[:, :-1, :, None] + steps + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
    )
    pair = pair * both[..., None, None]
    seen = truth[:, :-1, :, None] * truth[:, 1:, None, :] * both[..., None, None]
    gradient = np.einsum("ptf,pt->f", x, gap[..., 1] - gap[..., 0])
    return gradient, (seen - pair).sum((0, 1)), gap[:, 0].sum(0)


def fit_blocks(pages: list[tuple[str, list[bool]]], rounds: int = 200, decay: float = 0.05) -> BlockModel:
    """Maximise the penalised likelihood of labelled pages by AdaGrad."""
    found = [([block_features(b) for b in leaf_blocks(page)], labels) for page, labels in pages]
    found = [(features, labels) for features, labels in found if features]
    if any(len(features) != len(labels) for features, labels in found):
        raise ValueError("a page needs one label for each leaf block")
    names = sorted({name for features, _ in found for f in features for name in f})
    place = {name: k for k, name in enumerate(names)}
    length = max(len(labels) for _, labels in found)
    x = np.zeros((len(found), length, len(names)), np.float32)
    y, present = np.zeros((len(found), length), bool), np.zeros((len(found), length), bool)
    for p, (features, labels) in enumerate(found):
        present[p, : len(labels)], y[p, : len(labels)] = True, labels
        for t, block in enumerate(features):
            x[p, t, [place[name] for name in block]] = 1
    state = [np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)]
    squares = [np.full_like(part, 1e-6) for part in state]
    for _ in range(rounds):
        for part, square, gradient in zip(state, squares, _gradient(x, y, present, *state)):
            gradient = gradient - decay * part
            square += gradient**2
            part += 0.5 * gradient / np.sqrt(square)
    return BlockModel(dict(zip(names, state[0].tolist())), state[1], state[2])


@lru_cache(maxsize=2)
def default_model(pages: int = 500, seed: int = 20) -> BlockModel:
    """Fitted once in a session for each set of arguments."""
    random = np.random.default_rng(seed)
    return fit_blocks([labelled_page(random) for _ in range(pages)])


def main_text(pages: DataFrame, model: BlockModel | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` to every row and drop ``html``: the blocks of the article in
    page order, joined by a line break.

    Null html counts as empty and gives an empty text, as does a page without article blocks. Pages
    are read whole and each by itself, without a shuffle; repeated rows get equal texts, and columns
    with the names of the results are replaced.
    """
    model = model or default_model()

    def prepare():
        weights, known = model.weights, {}

        def score(block: Block) -> float:
            features = block_features(block)
            found = known.get(features)
            if found is None:
                if len(known) > 100_000:
                    known.clear()
                found = known[features] = sum(weights.get(name, 0.0) for name in features)
            return found

        def extract(pages: list[str]) -> list[list]:
            texts = []
            for blocks in map(leaf_blocks, pages):
                labels = model.decode(list(map(score, blocks)))
                texts.append("\n".join(b.text for b, label in zip(blocks, labels) if label))
            return [texts, list(map(len, texts))]

        return extract

    return add_columns(pages, "html", "text string, n_chars long", prepare, drop_source=True)
