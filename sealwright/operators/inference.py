"""Inference by a pluggable provider; the stubs answer without any model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InferenceProviderError
from ..model import Step
from . import candidates as C

STUB_MODEL, CYCLE_MODEL = "stub-v1", "stub-cycle-v1"
PROMPT_HEAD = 64
#: The cycling stub's answers (fixed values).
CYCLE = (
    "ACME Corp",
    "Globex Industries",
    "Initech LLC",
)
ANSWER = "struct<text:string,model:string,prompt_tokens:int,completion_tokens:int,error:string>"


def _count(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an int")
    if value < 0:
        raise ValueError(f"{name} must not be negative")
    return value


@dataclass(frozen=True)
class Usage:
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0

    def __post_init__(self):
        for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
            _count(getattr(self, name), name)


@dataclass(frozen=True)
class Request:
    prompt: str
    temperature: float = 0.0
    max_tokens: int | None = None

    def __post_init__(self):
        if not self.prompt:
            raise ValueError("the prompt is empty")
        if problem := bad_settings(self.temperature, self.max_tokens):
            raise ValueError(problem)


@dataclass(frozen=True)
class Completion:
    text: str
    model: str
    usage: Usage = Usage()


class Provider(Protocol):
    """Answers a request in a task. What it raises becomes a diagnostic of its row."""

    def complete(self, request: Request) -> Completion: ...


def bad_settings(temperature: Any, max_tokens: Any) -> str | None:
    if isinstance(temperature, bool) or not isinstance(temperature, (int, float)) or not 0 <= temperature <= 2:
        return "temperature must lie in [0, 2]"
    if max_tokens is not None and (isinstance(max_tokens, bool) or not isinstance(max_tokens, int) or max_tokens < 1):
        return "max_tokens must be a positive int"
    return None


def _answer(text: Column, model: str, used: tuple[Column, Column] | None = None) -> Column:
    tokens = used or (F.lit(0), F.lit(0))
    return F.struct(text.alias("text"), F.lit(model).alias("model"), tokens[0].cast("int").alias("prompt_tokens"), tokens[1].cast("int").alias("completion_tokens"), F.lit(None).cast("string").alias("error")).cast(ANSWER)


def stub_completion(prompt: Column) -> Column:
    """The stub's answer, which quotes the head of its prompt."""
    return F.concat(F.lit("<stub: "), F.substring(prompt, 1, PROMPT_HEAD), F.lit(">"))


def stub(prompt: Column) -> Column:
    return _answer(stub_completion(prompt), STUB_MODEL)


def cycling(prompt: Column, call: Column, texts: tuple[str, ...] = CYCLE, model: str = CYCLE_MODEL) -> Column:
    """ANSWER of the `call`-th call (0..): one text after the other whatever the prompt; usage counts characters."""
    if not texts:
        raise ValueError("texts must not be empty")
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(call, F.lit(len(texts))) + 1).cast("int"))
    return _answer(text, model, (F.length(prompt), F.length(text)))


class CyclingStub:
    """The cycling stub as a provider object, which counts its own calls."""

    def __init__(self, texts: tuple[str, ...] = CYCLE, model: str = CYCLE_MODEL):
        if not texts or not all(isinstance(t, str) for t in texts) or not model:
            raise ValueError("texts and a model's name are needed")
        self.texts, self.model, self.calls = tuple(texts), model, 0

    def reset(self) -> None:
        self.calls = 0

    def complete(self, request: Request) -> Completion:
        text = self.texts[self.calls % len(self.texts)]
        self.calls += 1
        return Completion(text, self.model, Usage(len(request.prompt), len(text), len(request.prompt) + len(text)))


def completed(provider: Provider, temperature: float, max_tokens: int | None) -> Callable[[Column], Column]:
    """prompt -> ANSWER by an object with complete(), in Arrow batches; an empty prompt isn't asked."""

    def one(prompt: str | None) -> tuple:
        if not prompt:
            return (None, None, None, None, None)
        try:
            done = provider.complete(Request(prompt, temperature, max_tokens))
            return (done.text, done.model, done.usage.prompt_tokens, done.usage.completion_tokens, None)
        except InferenceProviderError as e:
            return (None, None, None, None, e.message)
        except Exception as e:
            return (None, None, None, None, f"{type(e).__name__}: {e}")

    @F.pandas_udf(ANSWER)
    def ask(prompts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([one(p) for p in prompts], columns=["text", "model", "prompt_tokens", "completion_tokens", "error"], dtype=object)
        return rows.astype({"prompt_tokens": "Int32", "completion_tokens": "Int32"})

    return ask.asNondeterministic()


def compile_step(step: Step, ctx) -> tuple[Column, Column]:
    """config["provider"] is an object with complete(), or a function of a prompt column that gives text or ANSWER."""
    from .registry import builtin

    spec = builtin()["inference"].spec
    say = lambda code, message, severity="ERROR": C.diagnostic(code, severity, message, ctx.field_id)
    temperature, most = step.config.get("temperature", 0.0), step.config.get("max_tokens")
    if problem := bad_settings(temperature, most):
        return C.none(), say("CAPABILITY_INVOKE_FAILED", f"inference: {problem}")
    provider = step.config.get("provider", stub)
    if callable(getattr(provider, "complete", None)):
        answer = completed(provider, temperature, most)(ctx.text)
    elif callable(provider):
        answer = provider(ctx.text)
        answer = _answer(answer, "") if provider is stub_completion or step.config.get("plain") else answer
    else:
        return C.none(), say("CAPABILITY_INVOKE_FAILED", "inference: the provider has no complete()")
    asked = F.length(ctx.text) > 0
    field = lambda name: F.get(F.transform(F.array(answer), lambda a: a[name]), 0)
    failed = field("error").isNotNull()
    found = F.transform(F.array(answer), lambda a: C.candidate(a["text"], C.evidence(spec.id, spec.version, int(spec.tier), spec.deterministic, ctx.field_id, model=a["model"], used=(a["prompt_tokens"], a["completion_tokens"]))))
    told = say("INFERENCE_OUTPUT_UNTRUSTED", "inference output is not evidence of the input", "WARNING")
    broken = say("INFERENCE_PROVIDER_ERROR", F.concat(F.lit("inference: "), field("error")))
    empty = say("CAPABILITY_INVOKE_FAILED", "inference: the prompt is empty")
    return F.when(asked & ~failed, found).otherwise(C.none()), F.when(~asked, empty).when(failed, broken).otherwise(told)
