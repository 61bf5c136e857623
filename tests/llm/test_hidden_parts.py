"""Parts of a page that are hidden, and parts that only speak of it."""

import pytest

from gymlake.llm.html_cut import blocks_of


@pytest.mark.parametrize("attributes,shown", [
    ('title="A hidden gem"', True), ('class="card hidden sm:block"', True), ("alt='hidden'", True), ('data-x="a hidden=1 b"', True), ('data-hidden="1"', True), ('title="aria-hidden=true"', True),
    ('data-css="display:none"', True), ('aria-hidden="false"', True), ('style="color:red"', True), ('style="--display:none"', True), ("hidden", False), ('id="a" hidden=""', False), ("HIDDEN='until-found'", False), ("id=a hidden/", False),
    ('aria-hidden="true"', False), ("aria-hidden=true", False), ('style="color:red; Display : none"', False), ('title="it\'s" hidden', False),
])
def test_hidden_by_its_own_attribute_only(attributes, shown):
    page = f"<body><p>Before.</p><div {attributes}><p>The article itself.</p></div></body>"
    assert ("The article itself." in [b.text for b in blocks_of(page)]) == shown
