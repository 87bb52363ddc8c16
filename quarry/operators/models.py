"""Embedders and generators over local transformer models, for boxes that have them.

torch and transformers are imported in the worker, once a model is made; without
them making one raises ImportError.
"""

from __future__ import annotations

import numpy as np

from quarry.operators.answers import Generator
from quarry.operators.vectors import Embedder, mean_pool

MAX_TOKENS = 512


def device_of(torch, wanted: str | None = None) -> str:
    """The wanted device, or the best that there is: cuda, then mps, then cpu."""
    if wanted:
        return wanted
    if torch.cuda.is_available():
        return "cuda"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cpu"


def transformer_embedder(name: str, device: str | None = None, max_tokens: int = MAX_TOKENS) -> Embedder:
    """Mean of a model's last token vectors, of texts cut at max_tokens."""

    def make():
        import torch
        import transformers

        at = device_of(torch, device)
        tokenizer = transformers.AutoTokenizer.from_pretrained(name)
        model = transformers.AutoModel.from_pretrained(name).to(at).eval()

        def embed(texts: list[str]) -> np.ndarray:
            batch = tokenizer(texts, padding=True, truncation=True, max_length=max_tokens, return_tensors="pt").to(at)
            with torch.no_grad():
                tokens = model(**batch).last_hidden_state
            return mean_pool(tokens.float().cpu().numpy(), batch["attention_mask"].cpu().numpy())

        return embed

    return make


def transformer_generator(name: str, device: str | None = None) -> Generator:
    """Greedy continuation of a chat prompt by a causal model."""

    def make():
        import torch
        import transformers

        at = device_of(torch, device)
        tokenizer = transformers.AutoTokenizer.from_pretrained(name)
        model = transformers.AutoModelForCausalLM.from_pretrained(name).to(at).eval()

        def answer(messages: list[dict[str, str]], most: int) -> str:
            prompt = tokenizer.apply_chat_template(messages, tokenize=False, add_generation_prompt=True)
            batch = tokenizer([prompt], return_tensors="pt").to(at)
            with torch.no_grad():
                out = model.generate(**batch, max_new_tokens=most, do_sample=False)
            return tokenizer.decode(out[0][batch["input_ids"].shape[1] :], skip_special_tokens=True)

        return answer

    return make
