"""A transport for the paged source: three pages of two rows; page 2 fails at first."""

failed = set()


def fetch(page):
    if page == 2 and page not in failed:
        failed.add(page)
        raise OSError("try again")
    return None if page > 3 else [{"id": page * 10 + i, "version": f"v{page}", "body": {"n": i}} for i in range(2)]
