"""Where rows come from: listings, pages, object contents, archives, images."""
