"""Checks of arguments before any job starts, and what follows from a model's configuration."""

from __future__ import annotations

from dataclasses import dataclass

TOKENIZERS, TASKS, LANGUAGES = ("char", "keychar", "spe"), ("mlm", "ast", "vi"), ("c", "python")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


def _above_zero(**values: float) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be greater than 0, not {value}")


def check_tokenizer(kind: str, vocab_file: str | None = None, model_file: str | None = None) -> None:
    """A piece tokenizer needs both its files."""
    _one_of("tokenizer", kind, TOKENIZERS)
    if kind == "spe" and not (vocab_file and model_file):
        raise ValueError("a piece tokenizer needs a vocabulary file and a model file")


def check_training(tokenizer: str, epochs: int, batch_size: int, learning_rate: float, vocab_file: str | None = None, model_file: str | None = None) -> None:
    check_tokenizer(tokenizer, vocab_file, model_file)
    _above_zero(epochs=epochs, batch_size=batch_size, learning_rate=learning_rate)


def check_evaluation(task: str, tokenizer: str, batch_size: int = 8, max_length: int = 128, language: str = "c", vocab_file: str | None = None, model_file: str | None = None) -> None:
    _one_of("task", task, TASKS)
    _one_of("language", language, LANGUAGES)
    check_tokenizer(tokenizer, vocab_file, model_file)
    _above_zero(batch_size=batch_size, max_length=max_length)


@dataclass(frozen=True)
class ModelConfig:
    """An encoder's sizes; heads must divide the hidden size."""

    vocab_size: int
    hidden_size: int = 768
    layers: int = 12
    heads: int = 12
    intermediate_size: int = 3072
    max_positions: int = 512
    token_types: int = 2

    def __post_init__(self) -> None:
        _above_zero(vocab_size=self.vocab_size, hidden_size=self.hidden_size, layers=self.layers, heads=self.heads)
        if self.hidden_size % self.heads:
            raise ValueError(f"hidden_size ({self.hidden_size}) must be a multiple of heads ({self.heads})")

    @property
    def parameters(self) -> int:
        """Embeddings, encoder layers and a language-model head whose output weights are the token embeddings."""
        h, i, v = self.hidden_size, self.intermediate_size, self.vocab_size
        embeddings = (v + self.max_positions + self.token_types) * h + 2 * h
        layer = 4 * (h * h + h) + 2 * h + (h * i + i) + (i * h + h) + 2 * h
        head = h * h + h + 2 * h + v
        return embeddings + self.layers * layer + head

    @property
    def megabytes(self) -> float:
        return self.parameters * 4 / (1024 * 1024)
