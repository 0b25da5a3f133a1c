"""What can go wrong for a caller, with the exit code that the command line ends with."""

from __future__ import annotations


class Problem(ValueError):
    code = 2


class NoTranscript(Problem, LookupError):
    """Nothing is indexed for a video."""

    code = 3


class CacheProblem(Problem):
    code = 5


class EmbeddingProblem(Problem):
    code = 6


class RetrievalProblem(Problem):
    code = 7


class ModelProblem(Problem):
    code = 8


class SettingsProblem(Problem):
    code = 9
