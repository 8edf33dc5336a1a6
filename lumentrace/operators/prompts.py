"""Prompts of the extraction: resolved from names, filled from templates, expanded from sample conversations, checked and mended.

All of this is about a handful of texts, so it runs on the driver; samples are bounded by their parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.operators import ranking
from lumentrace.operators.providers import Provider, retried

#: The parts of the extraction prompt; a part that is not given is left out with its line.
TEMPLATE = "{introduction}\n{task}\n{goal}\n{process}\n{focus}\n{format}\n{types}\n{example}"
#: What fills the template where nothing else is said, for one answer and for two.
PARTS = {
    "single_model": {"introduction": "You are shown an answer of a language model.", "goal": "List the behaviours that stand out in it.", "process": "Read the whole answer before you judge.", "format": "Answer with a JSON array of objects.", "types": "behavior_type is Positive, Negative (critical), Negative (non-critical) or Style."},
    "side_by_side": {"introduction": "You are shown the answers of Model A and Model B.", "goal": "List the behaviours in which they differ.", "process": "Read both answers before you judge.", "format": "Answer with a JSON array of objects that name the model.", "types": "behavior_type is Positive, Negative (critical), Negative (non-critical) or Style."},
}
EXPAND_ASK = "Describe in detail, from these conversations, what this task is about and what matters in it: {task}"
DISCOVER_ASK = "Write the {part} of a prompt that finds behaviours of models in this task, and answer with it alone: {task}"
FIX_ASK = "This prompt gave answers that were wrong: {error}\nMend it and answer with the prompt alone.\n\n{prompt}"
CLUSTER_ASK = "Rewrite this instruction so that it suits the task, and answer with it alone.\nTask: {task}\nInstruction: {prompt}"


def template(method: str = "single_model", **parts: str) -> str:
    """The extraction prompt of a method with some of its parts replaced; parts that are empty go with their lines."""
    values = PARTS[method] | {k: v for k, v in parts.items() if v is not None}
    filled = re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], ""), TEMPLATE)
    return "\n".join(line for line in filled.split("\n") if line.strip())


def taxonomy_prompt(labels: dict[str, str] | list[str]) -> str:
    """A prompt that asks for one label of a taxonomy, with descriptions where there are some."""
    named = labels if isinstance(labels, dict) else dict.fromkeys(labels, "")
    lines = [f"- {k}: {v}" if v else f"- {k}" for k, v in named.items()]
    return "\n".join(["Choose the label that fits the answer best:", *lines, f"Answer with a JSON object whose category is one of {', '.join(named)}."])


def resolved(method: str = "single_model", prompt: str | None = None, task: str | None = None, known: dict[str, str] | None = None) -> str:
    """The prompt to use: one of the known names, 'default' or nothing for the method's own, else the text itself; a task description is put in.

    Text with a {task} place gets the task there, other text of one's own stays as it is; ValueError for a single word that is no known name.
    """
    known = {"default": template(method, task=f"The task: {task}" if task else None)} | (known or {})
    if prompt is None or prompt in known:
        return known[prompt or "default"].replace("{task}", task or "")
    if re.fullmatch(r"\w+", prompt):
        raise ValueError(f"{prompt!r} is none of {', '.join(sorted(known))}")
    return prompt.replace("{task}", task or "")


class Expander(Protocol):
    """Anything that makes a fuller task description of a short one and some conversations."""

    def expand(self, task: str, traces: list[str]) -> str: ...


@dataclass
class ProviderExpander:
    """Asks a provider; where it fails the task stays as it was. Answers are kept for the same task and traces."""

    provider: Provider
    most: int = 4000

    def __post_init__(self):
        self.known: dict[tuple, str] = {}

    def expand(self, task: str, traces: list[str]) -> str:
        key = (task, *traces)
        if key not in self.known:
            asked = "\n\n".join([EXPAND_ASK.format(task=task), *(t[: self.most] for t in traces)])
            self.known[key] = retried(self.provider)(asked) or task
        return self.known[key]


def sampled_traces(conversations: DataFrame, n: int = 5, seed: int = 42, column: str = "model_response", most: int = 4000) -> list[str]:
    """At most ``n`` conversations as text, the same ones for the same seed."""
    rows = ranking.sample_rows(conversations.withColumn("_key", F.xxhash64(*[c for c in ("question_id", "model") if c in conversations.columns], F.lit(seed))), n, "_key")
    return [r[0] for r in rows.select(F.substring(F.coalesce(F.col(column).cast("string"), F.lit("")), 1, most)).collect()]


def mended(prompt: str, verify: Callable[[str], str | None], provider: Provider, attempts: int = 3) -> tuple[str, str | None]:
    """The prompt, mended by a provider while ``verify`` finds an error in it, and the error that is left; None if there is none."""
    error = verify(prompt)
    for _ in range(attempts):
        if error is None:
            break
        prompt = retried(provider)(FIX_ASK.format(error=error, prompt=prompt)) or prompt
        error = verify(prompt)
    return prompt, error


def generated(task: str, conversations: DataFrame, provider: Provider, method: str = "single_model", expander: Expander | None = None, verify: Callable[[str], str | None] | None = None, samples: int = 5, attempts: int = 3, naming: dict[str, str] | None = None) -> dict[str, str]:
    """Prompts for a task: 'extraction', 'task' (expanded) and one for each instruction of ``naming``, suited to the task.

    The parts introduction, goal and process come from a provider. A prompt in which ``verify`` still finds an error after
    ``attempts`` gives way to the method's own. Failed calls leave what was there.
    """
    ask = retried(provider)
    wide = (expander or ProviderExpander(provider)).expand(task, sampled_traces(conversations, samples))
    parts = {p: ask(DISCOVER_ASK.format(part=p, task=wide)) for p in ("introduction", "goal", "process")}
    prompt = template(method, task=f"The task: {wide}", **{k: v for k, v in parts.items() if v})
    error = None
    if verify:
        prompt, error = mended(prompt, verify, provider, attempts)
    out = {"task": wide, "extraction": prompt if error is None else resolved(method, task=task)}
    return out | {k: ask(CLUSTER_ASK.format(task=wide, prompt=v)) or v for k, v in (naming or {}).items()}
