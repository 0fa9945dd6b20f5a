"""Errors with codes."""

from __future__ import annotations

# Codes and their messages.
MESSAGES = {
    "RAG_001": "Index not found",
    "RAG_002": "Embedding generation failed",
    "RAG_003": "Index creation failed",
    "RAG_004": "Search operation failed",
    "RAG_005": "Invalid input parameter",
    "RAG_006": "Content exceeds size limit",
    "RAG_007": "No embedding providers available",
    "RAG_008": "Embedding provider timed out",
    "RAG_009": "Circuit breaker is open",
    "RAG_010": "Rerank operation failed",
    "RAG_011": "Document parsing failed",
    "RAG_012": "Cache operation failed",
    "RAG_013": "Configuration is invalid",
    "RAG_014": "Document not found",
    "RAG_015": "Batch operation failed",
    "RAG_016": "Hybrid search merge failed",
    "RAG_017": "Unsupported document format",
    "RAG_018": "Embedding manager not initialized",
}
INVALID_INPUT, TOO_LARGE, NO_PROVIDERS, CIRCUIT_OPEN, EMBEDDING_FAILED = "RAG_005", "RAG_006", "RAG_007", "RAG_009", "RAG_002"
RERANK_FAILED, CONFIG_INVALID, NOT_FOUND = "RAG_010", "RAG_013", "RAG_014"


class EngineError(Exception):
    def __init__(self, code: str, detail: str = "", cause: BaseException | None = None):
        self.code, self.detail = code, detail
        self.message = MESSAGES.get(code, "Unknown error")
        self.__cause__ = cause
        text = f"[{code}] {self.message}" + (f": {detail}" if detail else "")
        super().__init__(text + (f" (caused by: {cause})" if cause is not None else ""))


def has_code(error: BaseException, code: str) -> bool:
    return isinstance(error, EngineError) and error.code == code


def require(ok: bool, code: str, detail: str) -> None:
    if not ok:
        raise EngineError(code, detail)
