"""Secrets that stand right after an equals sign."""

from __future__ import annotations

import pytest

from understory.llm import secrets


@pytest.mark.parametrize("name", ["AWS_SECRET_ACCESS_KEY=", "CLIENT_KEY=", "https://x.example/p?sig=", "a=b&sig=", "x=="])
def test_values_after_equals_signs(name):
    value = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE9"
    for t in (name + value, name + value + "==", f"export {name}{value}\nnext"):
        assert any(k == "entropy" and t[a:b].startswith(value) for k, a, b in secrets.finder()(t)[1]), t
    assert secrets.finder()(name + "an-ordinary-slug-of-words")[1] == []
