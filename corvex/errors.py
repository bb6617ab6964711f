"""Errors, raised on the driver wherever the plan allows it."""


class CorvexError(Exception):
    """Base of all."""


class InvalidConfig(CorvexError, ValueError):
    pass


class DimensionMismatch(CorvexError, ValueError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected dimension {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class EmptyCollection(CorvexError, ValueError):
    pass


class IndexNotBuilt(CorvexError):
    pass


class NodeNotFound(CorvexError, KeyError):
    pass


class StorageError(CorvexError, OSError):
    pass


class SignatureError(CorvexError):
    pass


class WorkspaceNotFound(CorvexError, KeyError):
    pass


class NotFound(CorvexError):
    pass


class AuthenticationFailed(CorvexError):
    pass


class RateLimited(CorvexError):
    def __init__(self, seconds: int):
        super().__init__(f"limit reached, wait {seconds} s")
        self.seconds = seconds


class ApiError(CorvexError):
    def __init__(self, status: int, message: str):
        super().__init__(f"status {status}: {message}")
        self.status = status
