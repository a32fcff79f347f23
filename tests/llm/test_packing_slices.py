"""Texts are tokenised in small slices: a worker's memory follows the slice."""
import inspect

from storewatch.llm import packing


def test_slices_of_texts_are_small():
    assert inspect.signature(packing.pieces).parameters["slice_bytes"].default <= 2 << 20
