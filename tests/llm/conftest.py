import os

import pytest

from millrace.llm.tokens import TOKENIZER_DIR


@pytest.fixture(autouse=True)
def tokenizers():
    if not os.path.isdir(TOKENIZER_DIR):
        pytest.skip("no tokenizer files here")
