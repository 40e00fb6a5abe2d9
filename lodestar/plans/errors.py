"""Errors with a code and an HTTP-like status."""


class SearchError(Exception):
    status, default = 500, "internal_error"

    def __init__(self, message: str, code: str | None = None) -> None:
        super().__init__(message)
        self.code = code or self.default


class ValidationError(SearchError):
    status, default = 400, "validation_error"


class ConfigurationError(SearchError):
    status, default = 503, "search_configuration_error"


class UpstreamError(SearchError):
    status, default = 502, "search_upstream_error"


class NotFoundError(SearchError):
    status, default = 404, "not_found"


class NotAvailableError(SearchError):
    status, default = 501, "not_available"
