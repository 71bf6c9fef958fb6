import random
import string

import pytest
from quadrille.llm import secret_scan as s


@pytest.mark.parametrize("letters", [string.digits, string.ascii_letters, "0123456789abcdef", string.ascii_letters + string.digits])
def test_random_strings_of_each_class_are_found(spark, letters):
    rng = random.Random(6)
    for n in (20, 32, 40):
        texts = [(i, "key " + "".join(rng.choice(letters) for _ in range(n)) + " end") for i in range(200)]
        rows = s.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert sum(any(x.kind == 3 for x in r.all_spans) for r in rows) >= 180
