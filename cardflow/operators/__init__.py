"""DataFrame -> DataFrame feature, network, exposure and ranking operators."""
