"""Errors of the request interface; each names the function that failed."""


class RequestError(ValueError):
    """Base of all request errors."""


class InvalidJson(RequestError):
    def __init__(self, function: str, detail: str):
        super().__init__(f"{function}: the input is no JSON: {detail}")


class MissingField(RequestError):
    def __init__(self, function: str, field: str):
        super().__init__(f"{function}: field '{field}' is missing")


class InvalidFieldType(RequestError):
    def __init__(self, function: str, field: str, expected: str):
        super().__init__(f"{function}: field '{field}' is not {expected}")


class UnknownPrompt(RequestError):
    def __init__(self, name: str):
        super().__init__(f"resolve_prompt: there is no template '{name}'")


class ParseError(RequestError):
    def __init__(self, function: str, detail: object):
        super().__init__(f"{function}: {detail}")
