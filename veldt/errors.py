"""Errors.  Each is also the built-in kind that callers of the public API expect."""


class GraphError(Exception):
    pass


class ParseError(GraphError, ValueError):
    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} (at position {position})")
        self.position = position


class ConfigError(GraphError, ValueError):
    pass


class PlanError(GraphError, ValueError):
    pass


class InvalidPatternError(GraphError, ValueError):
    pass


class UnsupportedFeatureError(GraphError, NotImplementedError):
    pass


class ExecutionError(GraphError, RuntimeError):
    pass
