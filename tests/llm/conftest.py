import pytest

pytest.importorskip("quillon.llm")
