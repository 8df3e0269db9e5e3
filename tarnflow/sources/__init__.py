"""Where rows come from and go to: files, streams' inputs, versioned tables."""
