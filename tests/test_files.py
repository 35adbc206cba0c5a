"""Word and mail files."""

import zipfile

from memlattice.sources import files, parsers


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{para('pre')}{para('Title', 'Heading1')}{para('x')}{para('y')}{para('Sub', 'Heading2')}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = files.docx_sections(files.read_files(spark, f"file://{tmp_path}", "*.docx")).orderBy("idx").collect()
    assert [(r.level, r.heading, r.content) for r in got] == [(1, "", "pre"), (1, "Title", "x\ny"), (2, "Sub", "")]


def test_mail(spark, tmp_path):
    (tmp_path / "1.eml").write_text("Message-ID: <a@x>\nDate: Thu, 01 Jan 2026 10:00:00 +0000\nFrom: A <a@x>\nSubject: Plan\n\nhello\nthere\n")
    (tmp_path / "2.eml").write_text("Message-ID: <b@x>\nReferences: <z@x> <a@x>\nDate: Fri, 02 Jan 2026 10:00:00 +0000\nSubject: Re: Plan\nContent-Type: text/html\n\n<p>ok <b>then</b></p>\n")
    mails = files.mail_messages(files.read_files(spark, f"file://{tmp_path}", "*.eml"))
    got = mails.orderBy("msgid").collect()
    assert [(r.msgid, r.in_reply_to, r.subject, r.body) for r in got] == [("a@x", None, "Plan", "hello there"), ("b@x", "a@x", "Re: Plan", "ok then")]
    tree = {r.msgid: (r.root, r.depth) for r in parsers.mail_threads(mails).collect()}
    assert tree == {"a@x": ("a@x", 0), "b@x": ("a@x", 1)}
