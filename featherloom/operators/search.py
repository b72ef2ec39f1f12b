"""The search over feature programs: a driver loop over a source of candidates, an evaluator and a buffer."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from typing import Protocol

from pyspark.sql import DataFrame

from featherloom.operators.budget import within_budget
from featherloom.operators.buffer import BufferConfig, draw_parents, reset
from featherloom.operators.prompt import Frame, render
from featherloom.operators.chat import Chat
from featherloom.operators.program import FeatureProgram, UnsupportedProgram, calls_ancestor, canonical, program_of, strip_to_body, trim_body


class CandidateSource(Protocol):
    """Gives answers to a prompt; a language model behind a network, saved programs, or changes by rule."""

    def sample(self, prompt: str, parents: list[str], n: int) -> list[str]: ...


@dataclass
class Replay:
    """Saved programs, one after the other."""

    programs: Iterator[str]

    def sample(self, prompt: str, parents: list[str], n: int) -> list[str]:
        return [p for _, p in zip(range(n), self.programs)]


@dataclass
class Mutation:
    """Parents with one assignment added, of a form and columns chosen at random."""

    columns: list[str]
    seed: int = 42
    made: int = 0

    def sample(self, prompt: str, parents: list[str], n: int) -> list[str]:
        out = []
        for _ in range(n):
            self.made += 1
            rng = random.Random(f"{self.seed}:{self.made}")
            a, b = rng.choice(self.columns), rng.choice(self.columns)
            name = f"mixed_{self.made}"
            line = rng.choice([f"df['{name}'] = df['{a}'] / (df['{b}'] + 1)", f"df['{name}'] = df['{a}'] * df['{b}']", f"df['{name}'] = np.log1p(df['{a}'].abs())", f"df['{name}'] = (df['{a}'] > df['{b}']).astype(int)"])
            body = strip_to_body(rng.choice(parents)) if parents else "    df = df_input.copy()\n    return df\n"
            head, _, tail = body.rpartition("    return ")
            out.append(program_of(f"{head}    {line}\n    return {tail}"))
        return out


#: Kinds of sources by name.
SOURCES = {"replay": Replay, "mutation": Mutation, "chat": Chat}


def make_source(kind: str, **options) -> CandidateSource:
    """A source by its name; options that it doesn't have are left out, an unknown name is a ValueError."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind}; there are {', '.join(sorted(SOURCES))}")
    taken = {f.name for f in fields(SOURCES[kind])}
    return SOURCES[kind](**{k: v for k, v in options.items() if k in taken})


@dataclass
class Candidate:
    order: int
    source: str
    score: float | None
    island: int | None
    reason: str | None = None
    signature: tuple[float, ...] = ()


_POPULATION = "island long, candidate long, signature array<double>, length long, score double"


@dataclass
class Search:
    """Islands of candidates; ids start at 2, the seed being 0, which every island gets.

    ``frame`` is one input or several by name, and ``evaluate`` gives the score of a frame, the larger the better: a candidate's score is the mean over the inputs that it can be applied to, its signature
    their scores by name. A candidate that doesn't compile, names an earlier version, or takes longer than budget_s has no score. Programs that are equal but for layout aren't evaluated again.

    The population is a table (see population): parents are drawn from it by the shares of clusters and of their members (buffer.draw_parents), and after each reset_period_s of the config the
    weaker half of the islands starts anew (buffer.reset). The loop ends after max_samples, or ``patience`` rounds without a better one; the last round may go over max_samples.
    """

    frame: DataFrame | dict[str, DataFrame]
    evaluate: Callable[[DataFrame], float]
    source: CandidateSource
    seed_program: str
    islands: int = 3
    per_round: int = 3
    max_samples: int = 60
    patience: int = 24
    parents: int = 2
    seed: int = 42
    budget_s: float = 600.0
    config: BufferConfig | None = None
    frames: list[Frame] = field(default_factory=list)
    columns: str = ""
    rows: str = ""
    log: list[Candidate] = field(default_factory=list)
    members: list[tuple[int, int]] = field(default_factory=list)
    clock: Callable[[], float] = time.monotonic

    @property
    def inputs(self) -> dict[str, DataFrame]:
        return self.frame if isinstance(self.frame, dict) else {"": self.frame}

    def _judge(self, source: str) -> tuple[tuple[float, ...], str | None]:
        """(scores by the names of the inputs, null), or none and why the last one failed."""
        scores, why = [], None
        for _, frame in sorted(self.inputs.items()):
            made, reason = FeatureProgram(source).apply_or_keep(frame)
            if reason is None:
                found, reason = within_budget(frame.sparkSession, self.budget_s, lambda made=made: self.evaluate(made))
                if reason is None and isinstance(found, (int, float)) and found == found:
                    scores.append(float(found))
            why = reason or why
        return tuple(scores), None if scores else why or "no score"

    def _score(self, source: str, known: dict[str, tuple]) -> tuple[tuple[float, ...], str | None]:
        if calls_ancestor(source):
            return (), "it calls an earlier version"
        try:
            key = canonical(source)
        except UnsupportedProgram as e:
            return (), str(e)
        if key not in known:
            known[key] = self._judge(source)
        return known[key]

    def population(self) -> DataFrame:
        """(island, candidate, signature, length, score) of the candidates that the islands hold."""
        of = {c.order: c for c in self.log}
        rows = [(island, k, list(of[k].signature), len(of[k].source), of[k].score) for island, k in self.members]
        return next(iter(self.inputs.values())).sparkSession.createDataFrame(rows, _POPULATION)

    def _reset(self, turn: int) -> None:
        self.members = sorted((r.island, r.candidate) for r in reset(self.population(), self.seed + turn).select("island", "candidate").collect())  # at most one row a candidate and island

    def run(self) -> Candidate:
        rng, known = random.Random(self.seed), {}
        config = self.config or BufferConfig(functions_per_prompt=self.parents, islands=self.islands)
        signature, why = self._score(self.seed_program, known)
        if not signature:
            raise UnsupportedProgram(f"the seed program: {why}")
        best = Candidate(0, self.seed_program, sum(signature) / len(signature), None, None, signature)
        self.log = [best]
        self.members = [(k, 0) for k in range(config.islands)]
        order, stale, turn, since = 1, 0, 0, self.clock()
        while order <= self.max_samples and stale < self.patience:
            turn += 1
            island = rng.randrange(config.islands)
            drawn = draw_parents(self.population().filter(f"island = {island}"), config, self.seed + turn).orderBy("score", "candidate", "turn").collect()  # functions_per_prompt rows
            of = {c.order: c.source for c in self.log}
            parents = [of[r.candidate] for r in drawn]
            answers = self.source.sample(render(parents, self.columns, self.rows, self.frames, rng), parents, self.per_round)
            if not answers:
                break
            stale += 1
            for answer in answers:
                order += 1
                source = program_of(trim_body(strip_to_body(answer)))
                signature, why = self._score(source, known)
                found = Candidate(order, source, sum(signature) / len(signature) if signature else None, island, why, signature)
                self.log.append(found)
                if found.score is not None:
                    self.members.append((island, order))
                    if found.score > best.score:
                        best, stale = found, 0
            if self.clock() - since >= config.reset_period_s:
                self._reset(turn)
                since = self.clock()
        return best

    def table(self) -> DataFrame:
        """(sample_order, function, score, island, reason) of all candidates so far."""
        spark = next(iter(self.inputs.values())).sparkSession
        return spark.createDataFrame([(c.order, c.source, c.score, c.island, c.reason) for c in self.log], "sample_order long, function string, score double, island long, reason string")
