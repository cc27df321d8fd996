import pytest

from skein.llm.residue import residue_of


@pytest.mark.parametrize("text", ["[Scripts are disabled in your browser]", "(JS is required)", "<p>Scripting is turned off"])
def test_script_messages_need_no_space_before(text):
    assert residue_of(text)["scripts"] == 1
